"""Every registered query runs, and equals its checking SQL where it has one."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not found")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(FOLDER))
    rows = [tuple(r) for r in df.collect()]
    if name in CHECKS:
        result = db.execute(CHECKS[name])
        columns = [c[0] for c in result.description]
        assert table(df.columns, rows) == table(columns, result.fetchall())


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "document_type" in df.columns
