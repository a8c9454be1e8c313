"""Every registered query against its SQL in DuckDB."""

import check
import pytest

from gopmill.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", list(all_queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict = check.compare(spark, con, all_queries.QUERIES[name], all_queries.ORACLES.get(name), FOLDER)
    assert verdict == ""
