"""Counts of the rows that a stream's watermark has dropped, written down for each query and batch."""

from __future__ import annotations

import contextlib
import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gopmill.sources.files import filesystem

SCHEMA = "query_id string, name string, batch_id bigint, operator string, late_rows bigint"


class LateRows(StreamingQueryListener):
    """``with LateRows(spark, folder): ...`` notes the late rows of every batch of the session's queries.

    A batch has one small file, named by its query and number, so a repeated batch is counted once and no listener reads what
    another wrote. Batches without late rows leave none. The folds of this package see each row, so a count is one of rows;
    an aggregate is merged before the watermark looks at it, and its count is one of groups.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        # what the listener bus still holds is noted before the listener goes
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [
            {"query_id": str(progress.id), "name": progress.name, "batch_id": progress.batchId, "operator": f"{at}-{o.operatorName}", "late_rows": o.numRowsDroppedByWatermark}
            for at, o in enumerate(progress.stateOperators)
            if o.numRowsDroppedByWatermark
        ]
        if rows:
            store, root = filesystem(self.folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{progress.id}-{progress.batchId}.json") as out:
                out.write("".join(json.dumps(row) + "\n" for row in rows).encode())


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, name, batch_id, operator, late_rows) of what LateRows has noted there."""
    with contextlib.suppress(OSError):
        store, root = filesystem(folder)
        if store.get_file_info(root).type == fs.FileType.Directory:
            return spark.read.schema(SCHEMA).json(folder)
    return spark.createDataFrame([], SCHEMA)


def late_rows_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return late_rows(spark, folder).groupBy("query_id", "name").agg(F.sum("late_rows").alias("late_rows"), F.count_distinct("batch_id").alias("batches"))
