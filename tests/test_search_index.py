"""Indexed search against the scan of every text."""

import random

import numpy as np
import pytest

from docketlake.operators import search_index
from docketlake.operators.documents import search_documents

SCHEMA = "doc_id long, original_name string, vendor string, text string, key string, slice string, row string"
ROWS = [
    (1, "Lease.pdf", "Acme", "The Tenant pays 50% of the rent.", "k", "s", "r"),
    (2, "b.pdf", None, "snake_case and C:\\temp", None, None, None),
    (2, "b.pdf", None, "snake_case and C:\\temp", None, None, None),
    (3, None, None, None, "x", None, None),
    (None, "", "", "", None, None, None),
    (None, "n", "ACME Ltd", "x" * 100_000 + " needle " + "y" * 100_000, None, None, None),
    (4, "a", "b", "STRAßE Ünïcode 😀😁😂 İstanbul ΟΔΟΣ", None, None, None),
    (5, "rent of", "ten", "ant", None, None, None),
]
QUERIES = (
    "tenant", "TENANT", "ten", "te", "", "%", "___", "50\\% of", "snake\\_case", "snake_case", "snake%temp", "temp%snake",
    "needle", "xxxx", "xy", "acme", "straße", "😀😁😂", "😁", "istanbul", "οδος", "rent", "absent words", "\\\\temp", "pays___%",
)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "index")
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    search_index.write_index(df, path)
    return df, path


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_the_scan(spark, index, query):
    df, path = index
    found = search_index.search_index(spark, path, query)
    assert found.columns == df.columns
    assert rows_of(found) == rows_of(search_documents(df, query))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    search_index.write_index(df, str(tmp_path / "index"))
    for query in ("tenant", "te"):
        found = search_index.search_index(spark, str(tmp_path / "index"), query)
        assert found.columns == df.columns and found.count() == 0


def test_pieces_and_grams():
    assert search_index.pieces("%a\\%b_cd%\\\\e%") == ["a%b", "cd", "\\e"]
    assert len(search_index.grams_of("abcabc")) == 3 and len(search_index.grams_of("ab")) == 0


def test_reads_only_slices_with_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "SLICE_ROWS", 10)
    monkeypatch.setattr(search_index, "FLUSH", 50)
    path = str(tmp_path / "index")
    df = spark.range(200).selectExpr(
        "id as doc_id", "'name' as original_name", "'vendor' as vendor", "concat('document number <', id, '>') as text")
    search_index.write_index(df, path)
    found = search_index.search_index(spark, path, "<77>")
    assert [r["doc_id"] for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [(slice" in plan
    assert search_index.search_index(spark, path, "number").count() == 200
    assert rows_of(search_index.search_index(spark, path, "<1_7>")) == rows_of(search_documents(df, "<1_7>"))


def test_distances_of_keys_take_few_bytes():
    rnd = random.Random(3)
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**33, 2**62] + [rnd.randrange(2 ** rnd.randint(1, 62)) for _ in range(500)], np.int64)
    data, sizes = search_index.packed(values)
    assert sizes[:6].tolist() == [1, 1, 1, 2, 2, 3]
    assert search_index.unpacked(data.tobytes()).tolist() == values.tolist()
    assert search_index.unpacked(b"").tolist() == []
    keys = [5, 7, 1 << search_index.SLICE_BITS, (1 << search_index.SLICE_BITS) + 300]
    lists = search_index._lists(keys, [search_index.grams_of(t) for t in ("abcd", "bcde", "abcd", "abc")])
    found = {gram: np.cumsum(np.append(first, search_index.unpacked(gaps))).tolist() for gram, first, gaps in zip(
        *(lists.column(c).to_pylist() for c in ("gram", "first", "gaps")))}
    assert found == {search_index.grams_of("abc")[0]: [keys[0], keys[2], keys[3]],
                     search_index.grams_of("bcd")[0]: keys[:3], search_index.grams_of("cde")[0]: [keys[1]]}
    assert dict(zip(lists.column("gram").to_pylist(), lists.column("n").to_pylist())) == {g: len(k) for g, k in found.items()}


def test_posting_lists_are_smaller_than_their_keys(spark, tmp_path):
    df = spark.range(3000).selectExpr(
        "id as doc_id", "'name' as original_name", "'vendor' as vendor", "concat('document number ', id % 97, ' of the archive') as text")
    search_index.write_index(df, str(tmp_path / "index"))
    listed = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert listed.selectExpr("sum(n)").first()[0] > 100_000
    assert sum(f.stat().st_size for f in (tmp_path / "index" / "postings").glob("*.parquet")) < 50_000
