"""Running a stream to the end of its present input, as the registered queries and tests do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from gopmill.session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed folds need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fresh_folder(spark: SparkSession, kind: str = "stream") -> str:
    return f"{scratch(spark)}/{kind}-{uuid.uuid4()}"


def drain(writer: DataStreamWriter, base: str) -> None:
    """Starts the stream and waits until it has taken in all input there is now."""
    query = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream gives for the input there is now, as a table in the checkpoint folder."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    base = fresh_folder(spark)
    out = f"{base}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(stream.writeStream.outputMode(mode).foreachBatch(write), base)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
