"""What several operators of this folder need from a table of documents."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "_key"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def key() -> Column:
    """A document's row in joins: a hash of doc_id and text, so that nulls and repeated ids do no harm.

    Rows equal in both are copies and get the same result.
    """
    return F.xxhash64(F.col("doc_id"), F.col("text")).alias(KEY)


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def release(df: DataFrame) -> DataFrame:
    """Lets Spark delete the shuffle files of jobs that are done with, and returns ``df``.

    It does so as soon as the driver's garbage collectors find their plans unused, which otherwise may be after all work.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def bucket_count(docs: DataFrame, bytes_each: int) -> int:
    """How many buckets keep what a task holds of all texts near ``bytes_each`` bytes; one aggregate, one number."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-total // bytes_each))
