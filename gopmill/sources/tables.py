"""Parquet tables and output listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gopmill.functions.text import base_name


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_by_asset(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """A table sorted by asset and position in range partitions of even size.

    Row groups then cover narrow asset and position ranges, so a later read of one asset skips the rest; a large
    asset spans as many files as it needs.
    """
    position = next((c for c in ("packet_idx", "frame_idx", "gop_idx", "segment_id") if c in df.columns), None)
    order = ["asset_id"] + ([position] if position else [])
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def list_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size) of each object under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"))
