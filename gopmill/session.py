"""Session helpers: a local session for tests and the checkpoint folder lookup."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "gopmill") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # without it every Column call records its Python stack, a third of the time to build a long plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one inside the warehouse.

    All executors must reach it. On a cluster a warehouse on the local disk is one machine's, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if named is None and not context.master.startswith("local") and _on_local_disk(spark, warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {warehouse} is on one machine")
    folder = named or f"{warehouse}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _on_local_disk(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def scratch(spark: SparkSession) -> str:
    """The folder of everything this application writes for its own use; ``remove_scratch`` deletes it."""
    if spark.sparkContext.applicationId not in _cleaned_at_exit:
        _cleaned_at_exit.add(spark.sparkContext.applicationId)
        atexit.register(_remove_quietly, spark)
    return f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


_cleaned_at_exit: set[str] = set()


def remove_scratch(spark: SparkSession) -> None:
    """Deletes what the application has written for itself. Results that are still to be computed from it are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_quietly(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the application has ended, and its driver with it
        with contextlib.suppress(Exception):
            remove_scratch(spark)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a Parquet table in the scratch folder, for a result several later steps read.

    Without it each of them would run the whole plan again. A table keeps column pruning and pushdown for its
    readers, and outlives any executor.
    """
    path = f"{scratch(df.sparkSession)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
