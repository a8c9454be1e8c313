import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import fixtures


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{fixtures.FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def edge(spark):
    return fixtures.frame(spark, fixtures.edges()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return fixtures.frame(spark, [])


@pytest.fixture(params=["small", "edge", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def with_clashes(df):
    """Extra columns with names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("_key", "_quality", "_failed", "key", "kept", "label", "fp", "start", "word", "words", "path", "bucket", "line", "n_words", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df
