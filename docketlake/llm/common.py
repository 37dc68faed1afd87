"""What the operators share: words, hashes, Arrow passes, staged tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketlake.session import shared_dir

# Bytes of input a Python worker holds at a time, and rows at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000
# Word hashes a worker remembers before it starts afresh.
REMEMBERED_WORDS = 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The work before it then runs once, and a lost executor costs only the
    tasks that read from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], ddl: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch; it returns the columns named in ``ddl``."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in source:
            if batch.num_rows:
                columns = work(batch)
                yield pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, T.StructType.fromDDL(ddl))


def utf8(name: str = "text") -> Column:
    """The text as bytes: Python then neither decodes nor encodes it."""
    return F.col(name).cast("binary").alias(name)


def row_tag(name: str = "text") -> Column:
    """128 bits that tell rows apart that share a doc_id, or have none, but not a text; a null text has zeros."""
    digest = F.substring(F.unhex(F.sha2(F.col(name).cast("binary"), 256)), 1, 16)
    return F.coalesce(digest, F.lit(bytes(16))).alias("tag")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() finds."""
    return text.split() if text else []


class WordHashes(dict):
    """64-bit hash of a word (as bytes), remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def u64(value: int) -> np.uint64:
    return np.uint64(value & (2**64 - 1))


def mixed(left: np.ndarray, right: np.ndarray | np.uint64, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs; order matters."""
    with np.errstate(over="ignore"):
        x = left * u64(0x9E3779B97F4A7C15) ^ (right + u64(0x632BE59BD9B4E019 * (2 * seed + 1)))
        x = (x ^ (x >> u64(32))) * u64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> u64(29))) * u64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> u64(32))


def gram_hashes(hashes: np.ndarray, length: int, seed: int = 0, known: dict | None = None) -> np.ndarray:
    """Hash of every run of ``length`` words, built from runs of half the length."""
    known = {} if known is None else known
    if len(hashes) < length:
        return hashes[:0]
    if length not in known:
        half, count = length // 2, len(hashes) - length + 1
        known[length] = mixed(hashes, u64(seed), seed) if length == 1 else mixed(
            gram_hashes(hashes, half, seed, known)[:count],
            gram_hashes(hashes, length - half, seed, known)[half:half + count], seed + length)
    return known[length]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
