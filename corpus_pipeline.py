"""A training corpus from ``documents``: stages applied in order, each on all that the one before it kept.

Every stage takes and, but for the last, returns the columns of documents. Null ids and texts, repeated rows and empty
tables go through as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gopmill.llm import decontamination, line_dedup, packing, quality, simhash
from gopmill.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy does not reject: that of the op9 query, and no insult at any length."""
    return quality.keep_good(docs, "v3")


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those made of such lines alone go."""
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_copies), ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark), ("packing", packed),
]
# edit distances by variants, fingerprints and reachability have no practical SQL: tests/llm/test_pipeline.py compares
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage returns is written and read again, as several later jobs read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
