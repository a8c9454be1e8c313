import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gopmill.session import local_session, remove_scratch

    session = local_session("8", "gopmill-tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    remove_scratch(session)


@pytest.fixture
def table(spark):
    """A small DataFrame from rows and a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make
