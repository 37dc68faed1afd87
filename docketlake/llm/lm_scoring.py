"""Language-model scores by deleted interpolation of n-gram estimates.

log10 P(text) sums, over its words and one end token, the logarithm of

    w2(b) c(v,w) / c(v)  +  w1(b) c(w) / N  +  w0(b) / (V + 1)

v is the word before, c counts in the training documents, and b is the frequency
bucket of v (the binary logarithm of its count).  The weights of each bucket are
learned by expectation-maximisation on the tuning documents, a tenth of the
training documents whose own counts are deleted for it.

Counting and scoring move sorted key blocks.  A task collects documents into
chunks; a chunk sends its distinct n-gram keys (64-bit hashes), delta-coded, to
the bucket of each key range; the bucket sums the counts and answers every chunk
in the order of its keys.  So an n-gram costs a few bytes however often it
occurs in a chunk, no table of n-grams reaches the driver or is broadcast, and
what travels grows with the corpus.  A chunk has the same size in every corpus; the
larger the corpus, the fewer keys are in a block.  Chunks are formed twice, from the same scan;
if the two disagree (an input that is not the same at each reading) the job stops.

Rows: a null text is empty and has one token, the end.  A null doc_id belongs to
the training documents.  Repeated rows count as often as they occur.  Without
training documents every token has probability 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import WordHashes, lists, mixed, stage, u64, utf8

# Tokens in a chunk, and bytes of text whose keys one bucket of an order holds.
CHUNK_TOKENS, BUCKET_BYTES = 1_500_000, 24 << 20
FOLDS = 10
TEST, TUNING, TRAIN = 0, 1, 2
# Probabilities are counted in tenths of a decade for the estimation.
STEPS, NONE = 10, -9999
BUCKETS = 40
END, START = u64(0x5D8A3C19E7F04B26), u64(0x1F83D9ABFB41BD6B)
_hashes = WordHashes()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, their bytes regrouped, compressed."""
    steps = np.diff(keys, prepend=u64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_counts(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


@dataclass
class Chunk:
    """Documents of one role that are counted and scored together."""

    ids: list = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id, text: bytes) -> None:
        words = text.lower().split()
        self.ids.append(doc_id)
        self.texts.append(text)
        self.hashes.append(np.append(_hashes.array(words), END))
        self.tokens += len(words) + 1


class Grams:
    """Keys of a chunk: sorted distinct words and pairs, and where each token stands in them."""

    def __init__(self, hashes: list[np.ndarray]):
        words = np.concatenate(hashes)
        self.ends = np.cumsum([len(h) for h in hashes])
        before = np.append(START, words[:-1])
        before[self.ends[:-1]] = START
        self.keys, self.at, self.count = [], [], []
        for keys in (mixed(words, u64(0), 21), mixed(before, words, 22)):
            distinct, at, count = np.unique(keys, return_inverse=True, return_counts=True)
            self.keys.append(distinct)
            self.at.append(at)
            self.count.append(count)
        # the word before; at the start of a document the end token stands for it: both occur once a document
        self.before = np.append(self.at[0][self.ends[-1] - 1], self.at[0][:-1])
        self.before[self.ends[:-1]] = self.at[0][self.ends[0] - 1]

    def blocks(self, buckets: int) -> Iterator[tuple[int, slice, int]]:
        """(bucket, part of the order's keys, order); buckets are key ranges, numbered through both orders."""
        for order, keys in enumerate(self.keys):
            bucket = ((keys >> u64(32)) * u64(buckets) >> u64(32)).astype(np.int64)
            borders = np.searchsorted(bucket, np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(borders)):
                yield order * buckets + int(i), slice(borders[i], borders[i + 1]), order


def _chunks(source: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[tuple[int, int, Chunk]]:
    """(number, role, chunk); the number comes from the task and the order of its rows."""
    base = TaskContext.get().partitionId() << 24
    open_: dict[int, Chunk] = {}
    for batch in source:
        for doc_id, fold, text in zip(*lists(batch, "doc_id", "fold", "text")):
            role = min(fold, TRAIN)
            chunk = open_.setdefault(role, Chunk())
            chunk.add(doc_id, text)
            if chunk.tokens >= chunk_tokens:
                yield base, role, open_.pop(role)
                base += 1
    for role, chunk in sorted(open_.items()):
        yield base, role, chunk
        base += 1


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _key_blocks(source: DataFrame, buckets: int, chunk_tokens: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("role", pa.int32()),
                        ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for number, role, chunk in _chunks(batches, chunk_tokens):
            grams = Grams(chunk.hashes)
            rows = [(bucket, number, role, packed_keys(grams.keys[order][part]), packed_counts(grams.count[order][part]))
                    for bucket, part, order in grams.blocks(buckets)]
            for i in range(0, len(rows), 200):
                yield _rows(schema, rows[i:i + 200])

    return source.mapInArrow(run, T.StructType.fromDDL("bucket int, chunk long, role int, keys binary, counts binary"))


def _answers(blocks: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, role, total and tuning counts in the order of the chunk's keys.

    A row with chunk -1 holds how many tokens of the bucket are in training documents
    and in tuning documents, and how many distinct ones are known.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        keys = [unpacked_keys(b) for b in group["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.concatenate([unpacked_counts(b) for b in group["counts"]])
        roles = np.repeat(group["role"].to_numpy(), [len(k) for k in keys])
        total = np.bincount(at, weights=np.where(roles != TEST, weight, 0), minlength=len(distinct)).astype(np.int64)
        tuning = np.bincount(at, weights=np.where(roles == TUNING, weight, 0), minlength=len(distinct)).astype(np.int64)
        rows, start = [], 0
        for chunk, role, own in zip(group["chunk"], group["role"], keys):
            part = at[start:start + len(own)]
            start += len(own)
            rows.append((chunk, bucket, role, packed_counts(total[part]),
                         packed_counts(tuning[part]) if role == TUNING else None, 0, 0, 0))
        if bucket < buckets:
            rows.append((-1, bucket, TRAIN, None, None, total.sum(), (total > 0).sum(), tuning.sum()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "role", "total", "tuning", "tokens", "known", "tuned"])

    return blocks.groupBy("bucket").applyInPandas(
        run, "chunk long, bucket int, role int, total binary, tuning binary, tokens long, known long, tuned long")


def _chunk_texts(source: DataFrame, chunk_tokens: int) -> DataFrame:
    """chunk, role, ids, sizes and the compressed texts of every chunk."""
    kinds = "chunk long, role int, ids array<long>, sizes array<int>, texts binary"
    schema = pa.schema([("chunk", pa.int64()), ("role", pa.int32()), ("ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])

    def run(batches):
        for number, role, chunk in _chunks(batches, chunk_tokens):
            texts = zstandard.ZstdCompressor(level=1).compress(b"".join(chunk.texts))
            yield _rows(schema, [(number, role, chunk.ids, [len(t) for t in chunk.texts], texts)])

    return source.mapInArrow(run, T.StructType.fromDDL(kinds))


def _with_counts(texts: DataFrame, answers: DataFrame) -> DataFrame:
    empty = {n: F.lit(None) for n in ("bucket", "total", "tuning")}
    return texts.withColumns(empty).unionByName(
        answers.select("chunk", "bucket", "total", "tuning"), allowMissingColumns=True).groupBy("chunk")


def _counted(group: pd.DataFrame, buckets: int) -> tuple[list, Grams, list[np.ndarray], list[np.ndarray]]:
    """Document ids, keys, and for words and pairs the total and tuning count of every key."""
    text = group[group["texts"].notna()].iloc[0]
    whole, texts, at = zstandard.ZstdDecompressor().decompress(text["texts"]), [], 0
    for size in text["sizes"]:
        texts.append(whole[at:at + size])
        at += size
    grams = Grams([np.append(_hashes.array(t.lower().split()), END) for t in texts])
    answers = group[group["texts"].isna()].set_index("bucket")
    total, tuning = ([np.zeros(len(k), np.int64) for k in grams.keys] for _ in range(2))
    for bucket, part, order in grams.blocks(buckets):
        total[order][part] = unpacked_counts(answers.at[bucket, "total"])
        if answers.at[bucket, "tuning"] is not None:
            tuning[order][part] = unpacked_counts(answers.at[bucket, "tuning"])
    if len(answers) != sum(1 for _ in grams.blocks(buckets)):
        raise RuntimeError("the documents were not the same at both readings: write them to a table first")
    return list(text["ids"]), grams, total, tuning


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unknown word, else one more than the binary logarithm of its count."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _ratio(top: np.ndarray, bottom) -> np.ndarray:
    return np.where(np.asarray(bottom) > 0, top / np.maximum(bottom, 1), 0.0)


def _levels(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(STEPS * np.log10(np.maximum(p, 1e-300))), NONE).astype(np.int64)


def learned_weights(evidence: np.ndarray, unknown: float, rounds: int = 60) -> np.ndarray:
    """Weights (pair, word, unknown) of each bucket from rows (bucket, pair level, word level, count)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(evidence):
        return weights

    def fit(rows: np.ndarray) -> np.ndarray:
        p = np.stack([np.where(rows[:, 1] == NONE, 0, 10.0 ** (rows[:, 1] / STEPS)),
                      np.where(rows[:, 2] == NONE, 0, 10.0 ** (rows[:, 2] / STEPS)),
                      np.full(len(rows), unknown)], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * rows[:, 3:]).sum(axis=0)
            w /= w.sum()
        w = np.maximum(w, (0, 1e-6, 1e-6))  # every token keeps a probability
        return w / w.sum()

    weights[:] = fit(evidence)
    for bucket in np.unique(evidence[:, 0]):
        weights[bucket] = fit(evidence[evidence[:, 0] == bucket])
    return weights


def score_documents(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(FOLDS - 1))
    source = docs.select("doc_id", fold.cast("int").alias("fold"), utf8()).withColumn(
        "text", F.coalesce("text", F.lit(b"")))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(size // bucket_bytes) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    answers = stage(_answers(_key_blocks(source, buckets, chunk_tokens), buckets), "answers")
    n, v, n_tuning = (x or 0 for x in answers.where("chunk = -1").agg(
        F.sum("tokens"), F.sum("known"), F.sum("tuned")).first())
    answers = answers.where("chunk >= 0")

    def evidence_of(group: pd.DataFrame) -> pd.DataFrame:
        _, grams, total, tuning = _counted(group, buckets)
        left = [t - x for t, x in zip(total, tuning)]
        before = left[0][grams.before]
        rows = np.stack([context_bucket(before), _levels(_ratio(left[1][grams.at[1]], before)),
                         _levels(_ratio(left[0][grams.at[0]], n - n_tuning))], axis=1)
        distinct, count = np.unique(rows, axis=0, return_counts=True)
        return pd.DataFrame(np.column_stack([distinct, count]), columns=["bucket", "pair", "word", "n"])

    kinds = "bucket long, pair long, word long, n long"
    # at most BUCKETS times the levels of two probabilities: bounded whatever the corpus
    evidence = _with_counts(
        _chunk_texts(source, chunk_tokens).where(F.col("role") == TUNING), answers.where(F.col("role") == TUNING),
    ).applyInPandas(evidence_of, kinds).groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()
    weights = learned_weights(np.array([tuple(r) for r in evidence], np.int64).reshape(-1, 4), 1 / (v + 1))

    def scores_of(group: pd.DataFrame) -> pd.DataFrame:
        ids, grams, total, _ = _counted(group, buckets)
        word, pair, before = total[0][grams.at[0]], total[1][grams.at[1]], total[0][grams.before]
        w = weights[context_bucket(before)]
        p = w[:, 0] * _ratio(pair, before) + w[:, 1] * _ratio(word, n) + w[:, 2] / (v + 1)
        starts = np.append(0, grams.ends[:-1])
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"),
            "held_out": group["role"].max() == TEST, "n_tokens": np.diff(grams.ends, prepend=0),
            "n_known": np.add.reduceat((word > 0).astype(np.int64), starts), "train_tokens": n,
            "base_score": np.add.reduceat(np.log10((word + 0.1) / (n + 0.1 * (v + 1))), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        })

    return _with_counts(_chunk_texts(source, chunk_tokens), answers).applyInPandas(
        scores_of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                   "base_score double, score double")
