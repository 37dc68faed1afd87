"""Posting lists of trigrams for substring search; candidates are confirmed on their fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketlake.operators.documents import search_documents

FIELDS = ("original_name", "vendor", "text")
SLICE_ROWS, MOST_SLICES = 10_000, 100_000  # rows of a slice, until there are that many slices
RAREST = 4  # lists read for one search; those left out can only be less selective
FLUSH = 1_000_000  # trigrams held by a task before it writes posting lists
SLICE_BITS = 33  # a row's key is its slice followed by its place in it
POSTINGS = "gram long, n int, first long, gaps binary"  # the first key, and what each further one adds


def grams_of(text: str) -> np.ndarray:
    """The distinct runs of three code points, 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of at least 0 in seven bits a byte, lowest first, the eighth on all but the last; the size of each."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >> bits > 0
    starts, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.uint8)
    for at in range(int(sizes.max(initial=0))):
        some = sizes > at
        out[starts[some] + at] = values[some] >> 7 * at & 127 | (sizes[some] > at + 1) * 128
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    held = np.frombuffer(data, np.uint8)
    if not len(held):
        return np.array([], np.int64)
    starts = np.flatnonzero(np.append(True, held[:-1] < 128))
    place = np.arange(len(held)) - np.repeat(starts, np.diff(np.append(starts, len(held))))
    return np.add.reduceat((held & 127).astype(np.int64) << 7 * place, starts)


def _lists(keys: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """One row per trigram with the keys of the rows it is in, in ascending order.

    A frequent trigram is in nearly every row, so most keys are one byte each, and alike.
    """
    owner = np.repeat(np.array(keys, np.int64), [len(g) for g in grams])
    every = np.concatenate(grams) if grams else np.array([], np.int64)
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.diff(every, prepend=-1))
    counts = np.diff(np.append(starts, len(every)))
    gaps = np.diff(owner, prepend=0)
    later = np.ones(len(owner), bool)
    later[starts] = False
    data, sizes = packed(gaps[later])
    upto = np.zeros(len(owner), np.int64)
    upto[later] = sizes
    ends = np.append(0, np.cumsum(upto)[np.append(starts[1:] - 1, len(owner) - 1)] if len(owner) else []).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(every[starts]), pa.array(counts.astype(np.int32)), pa.array(owner[starts]), lists], ["gram", "n", "first", "gaps"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of posting lists (first, gaps)."""
    for batch in batches:
        for first, gaps in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(np.append(first, unpacked(gaps.as_py()))))], ["key"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, grams, held = [], [], 0
    for batch in batches:
        # a batch may hold thousands of long texts, so its rows become Python's one by one
        for at in range(batch.num_rows):
            key, *fields = (column[at].as_py() for column in batch.columns)
            found = np.unique(np.concatenate([grams_of(f.decode("utf-8", "replace")) for f in fields if f] or [
                np.array([], np.int64)]))
            keys.append(key)
            grams.append(found)
            held += len(found)
            if held > FLUSH:
                yield _lists(keys, grams)
                keys, grams, held = [], [], 0
    if keys:
        yield _lists(keys, grams)


def write_index(df: DataFrame, path: str) -> None:
    """Write the rows of ``df`` and the posting lists of their name, vendor and text below ``path``.

    Rows are dealt evenly to slices, a folder each, whatever their ids are.  A task
    lists the trigrams of its rows before the shuffle; lists of one trigram stay
    apart, so one that every document has lies in many files.  Lists hold the distances
    of keys in as few bytes as they need, so they are a small part of the texts' size
    when they are dealt and stored.  Null fields list nothing.
    """
    slices = min(df.count() // SLICE_ROWS + 1, MOST_SLICES)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    df.limit(0).select(row).write.parquet(f"{path}/columns")
    keyed = df.repartition(slices).select(row, F.monotonically_increasing_id().alias("key"))
    keyed.withColumn("slice", _slice("key")).write.partitionBy("slice").parquet(f"{path}/rows")
    fields = [F.lower(f"row.{f}").cast("binary").alias(f) for f in FIELDS]
    lists = _rows(df.sparkSession, path).select("key", *fields).mapInArrow(_postings, POSTINGS)
    lists.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").write.option("compression", "zstd").parquet(f"{path}/postings")


def _slice(key: str) -> Column:
    return F.shiftright(key, SLICE_BITS)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("key", "long").add("slice", "long")).parquet(f"{path}/rows")


def pieces(pattern: str) -> list[str]:
    """The plain stretches of a LIKE pattern."""
    out, at = [""], 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\" and pattern[at + 1:at + 2] in ("%", "_", "\\"):
            at += 1
            out[-1] += pattern[at]
        elif char in "%_\\":
            out.append("")
        else:
            out[-1] += char
        at += 1
    return [p for p in out if p]


def query_grams(spark: SparkSession, query: str) -> list[int]:
    """Trigrams that every row matched by ``query`` has; lower case is the engine's, as in the match itself."""
    pattern = spark.range(1).select(F.lower(F.lit(f"%{query}%"))).first()[0]
    found = [grams_of(p) for p in pieces(pattern) if len(p) > 2]
    return np.unique(np.concatenate(found)).tolist() if found else []


def candidates(spark: SparkSession, path: str, grams: list[int]) -> DataFrame:
    """key of the rows that have the rarest of ``grams``; only the files and pages of these trigrams are read."""
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    wanted = postings.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n"))
    often = {r["gram"]: r["n"] for r in wanted.collect()}  # no longer than the query
    if len(often) < len(grams):
        return postings.where(F.lit(False)).select(F.col("first").alias("key"))
    rarest = sorted(grams, key=lambda g: (often[g], g))[:RAREST]
    each = postings.where(F.col("gram").isin(rarest)).select("first", "gaps").mapInArrow(_keys, "key long")
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("key")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows that ``search_documents`` finds for ``query``, read through the index below ``path``.

    Reads the lists of the query's rarest trigrams and the slices that hold
    candidates.  A query without three plain characters in a row has no trigram:
    all rows are read then.  Rows come with all columns they were indexed with.
    """
    rows, grams = _rows(spark, path), query_grams(spark, query)
    if grams:
        hits = candidates(spark, path, grams)
        held = [r[0] for r in hits.select(_slice("key")).distinct().collect()]  # at most MOST_SLICES numbers
        rows = rows.where(F.col("slice").isin(held)).join(hits, "key", "left_semi")
    return search_documents(rows.select("row.*"), query)
