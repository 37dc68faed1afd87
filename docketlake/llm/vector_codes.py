"""Compact codes for vectors: each part of a vector becomes the number of the nearest entry of a learned codebook.

Components are scaled to integers, so codes, errors and codebooks are exact and do not depend on how rows are dealt
to tasks.  Distances come from matrix products: integers are split into limbs so narrow that every float64 product
stays below 2^53, the products of limbs are put together in int64, and the first smallest distance wins.

Every round is one pass over the vectors.  A task adds up its rows by part and entry, so the shuffle carries a few
thousand numbers of each task, whatever its rows, and the driver sees one codebook.

Defined results: a vector that is null or holds a null or a component that is not finite is left out.  Vectors are as
long as the one of the smallest vec_id that is kept; a vector of another length keeps its row and has neither code
nor error.  A length that the parts do not divide is filled up with zeros.  With fewer vectors than entries there
are as many entries as vectors.  Components of any size are exact: beyond int64 plain integers take over, and an
error over 2^63 - 1 is null.  Equal vec_ids are separate rows; null ones come last.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import arrow_schema, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Sums travel in pieces of so many bits, as they may exceed a long.
PIECE = 40
LARGEST = 2**63 - 1
# A label's total is copied this often, so that the rows of a frequent label meet it in many tasks.
SALTS = 64


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` are the integer components of an entry; ``length`` is that of the vectors."""

    length: int
    scale: int
    entries: list[list[list[int]]]

    @property
    def width(self) -> int:
        return -(-self.length // len(self.entries))

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        numbers = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, code: bytes) -> list[float]:
        """The vector that a code stands for."""
        found = [x / self.scale for part, index in zip(self.entries, code) for x in part[index]]
        return found[:self.length]


def _safe_bits(width: int) -> int:
    """Integers below two to this power have squared distances below 2^62."""
    return (60 - (max(width, 1) - 1).bit_length()) // 2 - 1


def _limbs(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``values`` as ``count`` numbers of ``bits`` bits, lowest first; the last one carries the sign."""
    low = [(values >> (bits * i)) & ((1 << bits) - 1) for i in range(count - 1)]
    return [x.astype(np.float64) for x in (*low, values >> (bits * (count - 1)))]


def dot_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of int64 matrices, exact, from float64 products of limbs."""
    bits = (52 - (max(left.shape[1], 1) - 1).bit_length()) // 2
    longest = max((int(np.abs(x).max()).bit_length() for x in (left, right) if x.size), default=0)
    count = max(1, -(-longest // bits))
    total = np.zeros((len(left), len(right)), np.int64)
    others = _limbs(right, bits, count)
    for i, a in enumerate(_limbs(left, bits, count)):
        for j, b in enumerate(others):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row and its squared distance; matrices of int64, or of plain integers."""
    if vectors.dtype == object or entries.dtype == object:
        difference = vectors.astype(object)[:, None, :] - entries.astype(object)[None, :, :]
        distance = (difference * difference).sum(axis=2)
        best = np.array([min(range(len(row)), key=row.__getitem__) for row in distance], np.int64)
    else:
        distance = (vectors * vectors).sum(1)[:, None] - 2 * dot_products(vectors, entries) + (entries * entries).sum(1)
        best = distance.argmin(axis=1)
    return best, distance[np.arange(len(vectors)), best]


def _whole(value: float, scale: int) -> int:
    return int(value) * scale if abs(value) > 2.0**52 else math.floor(value * scale)


def _read(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, which of these have ``length`` components, and those rows as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = (lengths >= 0) & (bad[ends] == bad[starts])
    fits = kept & (lengths == length)
    matrix = values[starts[fits][:, None] + np.arange(length)]
    return kept, fits, matrix


def _integers(matrix: np.ndarray, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their integers by part (rows, parts, width): int64 for all rows that are safe, then the rest."""
    parts, width = len(books.entries), books.width
    limit = 2.0 ** _safe_bits(width)
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * books.scale)
    small = (np.abs(scaled) < limit).all(axis=1)
    if any(abs(x) >= limit for part in books.entries for entry in part for x in entry):
        small[:] = False
    for rows, kind in ((np.flatnonzero(small), np.int64), (np.flatnonzero(~small), object)):
        if len(rows):
            if kind is object:
                whole = np.array([[_whole(x, books.scale) for x in row] for row in matrix[rows].tolist()], object)
                whole = whole.reshape(len(rows), matrix.shape[1])
            else:
                whole = scaled[rows].astype(np.int64)
            padded = np.zeros((len(rows), parts * width), kind)
            padded[:, :whole.shape[1]] = whole
            yield rows, padded.reshape(len(rows), parts, width)


def _tables(books: Codebooks, kind: type) -> list[np.ndarray]:
    return [np.array(part, kind).reshape(len(part), books.width) for part in books.entries]


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << PIECE) - 1))
        value, place = value >> PIECE, place + 1


def _sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """Sum of the components by (part, entry, position); position -1 holds the count."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            matrix = _read(batch.column(0), books.length)[2]
            for _, integers in _integers(matrix, books):
                for part, entries in enumerate(_tables(books, integers.dtype)):
                    values = integers[:, part]
                    index, _ = nearest(values, entries)
                    for entry in np.unique(index).tolist():
                        mine = values[index == entry]
                        total[part, entry, -1] += len(mine)
                        for position, value in enumerate(mine.sum(axis=0).tolist()):
                            total[part, entry, position] += value
        rows = [(*key, place, piece) for key, value in total.items() for place, piece in _pieces(value)]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "part int, entry int, position int, place int, piece long"
    schema = arrow_schema(ddl)
    pieces = vectors.select("embedding").mapInArrow(work, T.StructType.fromDDL(ddl))
    added = pieces.groupBy("part", "entry", "position", "place").agg(F.sum(F.col("piece").cast("decimal(38,0)")).alias("piece"))
    found: dict[tuple[int, int, int], int] = defaultdict(int)
    for row in added.collect():  # a few numbers for every component of the codebooks
        found[row["part"], row["entry"], row["position"]] += int(row["piece"]) << (PIECE * row["place"])
    return found


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of ``vectors`` (vec_id, embedding): first the vectors of the smallest ids, then ``rounds`` of means.

    Means are rounded down; an entry that is nobody's nearest stays as it is.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    first = vectors.where(F.col("embedding").isNotNull() & finite).orderBy(
        F.col("vec_id").asc_nulls_last(), "embedding").select("embedding")
    head = first.limit(1).collect()
    length = len(head[0][0]) if head else 0
    width = -(-length // parts)
    chosen = [[_whole(float(x), scale) for x in row[0]] + [0] * (width * parts - length)
              for row in first.where(F.size("embedding") == length).limit(entries).collect()]
    books = Codebooks(length, scale, [[v[p * width:(p + 1) * width] for v in chosen] for p in range(parts)])
    for _ in range(rounds if chosen else 0):
        sums = _sums(vectors, books)
        books = Codebooks(length, scale, [
            [[sums[p, e, i] // sums[p, e, -1] for i in range(width)] if sums[p, e, -1] else old
             for e, old in enumerate(part)] for p, part in enumerate(books.entries)])
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error (squared distance) of every vector that is kept."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = batch.columns
            kept, fits, matrix = _read(column, books.length)
            codes, errors = [None] * len(kept), [None] * len(kept)
            places = np.flatnonzero(fits)
            for rows, integers in _integers(matrix, books) if books.entries and books.entries[0] else ():
                found = [nearest(integers[:, p], entries) for p, entries in enumerate(_tables(books, integers.dtype))]
                index = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = sum(f[1] for f in found)
                for at, code, value in zip(places[rows].tolist(), index, error.tolist()):
                    codes[at], errors[at] = code.tobytes(), value if value <= LARGEST else None
            mask = pa.array(kept)
            yield pa.record_batch([
                ids.cast(pa.int64()).filter(mask), labels.filter(mask), pa.array(codes, pa.binary()).filter(mask),
                pa.array(errors, pa.int64()).filter(mask)], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        work, f"vec_id long, label {kind}, code binary, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of the errors of a label; rows without label share one sum.

    Totals are added up before the shuffle; each is copied to SALTS keys, so that a
    label with a third of all rows is joined in many tasks.  A sum over 2^63 - 1 is null.
    """
    codes = stage(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    totals = sums.select(
        F.col("label").alias("of_label"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"),
        F.when(F.col("sum") <= F.lit(LARGEST), F.col("sum")).cast("long").alias("label_error"))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(
        totals, salted["label"].eqNullSafe(totals["of_label"]) & (salted["salt"] == totals["of_salt"]), "left",
    ).select("vec_id", "label", "code", "error", "label_error")


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors with the errors of their labels, and the codebooks that read them."""
    narrow = vectors.select("vec_id", "label", "embedding")
    books = fit(narrow)
    return with_label_errors(encode(narrow, books)), books
