import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docketlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.log.level": "ERROR",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over rows given as tuples."""
    def run(rows, schema, **columns):
        return [r.asDict() for r in spark.createDataFrame(rows, schema).select(
            *[c.alias(n) for n, c in columns.items()]
        ).collect()]

    return run
