"""MinHash near-deduplication with an LSH forest.

Every document's set of word shingles gets TREES x DEPTH minimum hashes.  Each
tree orders the distinct sets by its DEPTH values; sets that stand next to each
other there share the longest prefixes, and the NEIGHBOURS before each one that
share at least the first value are its candidates.  The depth adapts by itself:
in a crowded region of an order the neighbours are those that agree longest.
Orders are dealt by range, so a region of any size is spread over many tasks.

Candidates whose compared hashes make the wanted similarity impossible (by over
eight standard deviations) are left out; all others are confirmed on full sets.
The orders are walked twice.  First each set names the likeliest candidate of
each order and confirms the likeliest of them.  Sets that had candidates are
then ordered again, now with their components, and all candidates between
different components are confirmed; those inside one are never written.  Equal
sets are one node from the start.

A set is crowded in an order if sets beyond its NEIGHBOURS share its first value
there, or if the border of a range hides whether they do.  Pairs of sets that
are crowded in over SPARE orders are found by an exact prefix join instead: if
all shingles are put in one order, rare ones first, two similar sets share one
so early in both that enough can follow.  Pairs already in one component are
left out of it.

A link of similarity 0.85 is thus missed only between sets of which one is
crowded in SPARE orders at most, with a probability of 0.15 ** (TREES - SPARE),
about 6e-9, at most.

Rows: without words or text a document has an empty set, is linked with nothing
and is kept.  Repeated rows are equal sets.  A null doc_id is never the smallest
of a group that has any other; a group of null ids alone keeps them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import (
    WordHashes, gram_hashes, lists, map_batches, row_tag, signed, spare, stage, u64, utf8, words_of,
)
from docketlake.llm.components import components

SHINGLE, TREES, DEPTH, NEIGHBOURS = 5, 12, 6, 6
ROWS_PER_RANGE = 20_000
# Orders in which a set may be crowded without being given to the exact join.
SPARE = 2
# Counters of shingles that put rare ones first (they decide the work, not the result), and their rows.
BUCKETS, BUCKET_ROWS = 1 << 20, 256
SETS_PER_TASK = 5_000
# Sets of one shingle that the exact join compares at a time.
BLOCK = 500
# Blocks of one shingle that a task compares with all its others.
TASK_BLOCKS = 8
_hashes = WordHashes()
# Odd multipliers, one for each minimum hash.
_factors = [
    np.uint64(int.from_bytes(hashlib.blake2b(b"minhash %d" % i, digest_size=8).digest(), "little") | 1)
    for i in range(TREES * DEPTH)
]


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle."""
    words = words_of(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _hashes.array(words)
    if len(words) < size:
        return gram_hashes(hashes, len(words), 100 + len(words))
    return np.unique(gram_hashes(hashes, size, 11))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes (upper 32 bits) of non-empty sets, one row each."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    with np.errstate(over="ignore"):
        columns = [np.minimum.reduceat(values * f, starts) >> u64(32) for f in _factors]
    return np.stack(columns, axis=1).astype(np.uint32)


def set_features(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_shingles, digest of the set, signature, sketch; the last three are null for empty sets.

    The sketch has one byte of every minimum hash, to judge a pair by all of them.
    """
    def work(batch):
        ids, tags, texts = lists(batch, "doc_id", "tag", "text")
        sets = [shingle_set(t) for t in texts]
        full = [s for s in sets if len(s)]
        rows = signatures(full).astype(">u4") if full else np.zeros((0, TREES * DEPTH), ">u4")
        sketches = iter((rows & 255).astype(np.uint8))
        rows = iter(rows)
        return {
            "doc_id": ids, "tag": tags, "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "signature": [next(rows).tobytes() if len(s) else None for s in sets],
            "sketch": [next(sketches).tobytes() if len(s) else None for s in sets],
        }

    return map_batches(docs.select("doc_id", row_tag(), utf8()), work,
                       "doc_id long, tag binary, n_shingles long, digest binary, signature binary, sketch binary")


def candidates(sets: DataFrame, likely: float, nearest: bool) -> DataFrame:
    """a, b (digests, a < b) and alike: neighbours of different ``root`` in at least one of the orders.

    With ``nearest``, only the likeliest neighbour before each set in each order.
    A row without b says that the set a has candidates, or is crowded in ``alike`` orders.
    """
    count = sets.count() * TREES
    width = DEPTH * 4
    label = F.expr(f"substring(signature, tree * {width} + 1, {width})")
    ordered = sets.select(
        "digest", "root", "sketch", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"),
    ).select("tree", label.alias("label"), "digest", "root", "sketch").repartitionByRange(
        int(count // ROWS_PER_RANGE) + 1, "tree", "label", "digest")

    def rows(a: np.ndarray, b: list, alike: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(a), pa.binary()), pa.array(b, pa.binary()), pa.array(alike, pa.float64())],
                               names=["a", "b", "alike"])

    def alone(digests: np.ndarray, orders: float) -> pa.RecordBatch:
        return rows(digests, [None] * len(digests), np.full(len(digests), orders))

    def neighbours(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows that the next ones may still show to be crowded are kept back, with what is known of them
        last, told, beyond = None, np.zeros(0, bool), NEIGHBOURS + 1
        for batch in source:
            if not batch.num_rows:
                continue
            tree, labels, digests, roots, sketches = lists(batch, "tree", "label", "digest", "root", "sketch")
            now = (np.array(tree), np.frombuffer(b"".join(labels), ">u4").reshape(-1, DEPTH)[:, 0],
                   np.array(digests, object), np.array(roots, object),
                   np.frombuffer(b"".join(sketches), np.uint8).reshape(len(tree), -1))
            old = 0 if last is None else len(last[0])
            tree, value, digest, root, sketch = now if last is None else [np.concatenate(x) for x in zip(last, now)]
            full = np.concatenate([told, np.zeros(len(now[0]), bool)])
            if last is None:  # what stands before the first row is not seen
                full[:beyond] = (tree[:beyond] == tree[0]) & (value[:beyond] == value[0])
            far = (tree[beyond:] == tree[:-beyond]) & (value[beyond:] == value[:-beyond])
            full[beyond:] |= far
            full[:-beyond] |= far
            found = []
            for step in range(1, NEIGHBOURS + 1):
                at = np.arange(max(old, step), len(tree))
                at = at[(tree[at] == tree[at - step]) & (value[at] == value[at - step]) & (root[at] != root[at - step])]
                alike = (sketch[at] == sketch[at - step]).mean(axis=1) if len(at) else np.zeros(0)
                found.append((at[alike >= likely], at[alike >= likely] - step, alike[alike >= likely]))
            at, to, alike = (np.concatenate(x) for x in zip(*found))
            if nearest and len(at):
                yield alone(digest[np.union1d(at, to)], 0.0)
                likeliest = np.lexsort((-alike, at))
                likeliest = likeliest[np.unique(at[likeliest], return_index=True)[1]]
                at, to, alike = at[likeliest], to[likeliest], alike[likeliest]
            if len(at):
                ends = [(min(p), max(p)) for p in zip(digest[at], digest[to])]
                yield rows([x for x, _ in ends], [y for _, y in ends], alike)
            yield alone(digest[:-beyond][full[:-beyond]], 1.0)
            last, told = tuple(x[-beyond:] for x in (tree, value, digest, root, sketch)), full[-beyond:]
        if last is not None:  # nor what follows the last
            yield alone(last[2][told | (last[0] == last[0][-1]) & (last[1] == last[1][-1])], 1.0)

    found = ordered.sortWithinPartitions("tree", "label", "digest").mapInArrow(
        neighbours, T.StructType.fromDDL("a binary, b binary, alike double"))
    return found.groupBy("a", "b").agg(
        F.when(F.col("b").isNull(), F.sum("alike")).otherwise(F.max("alike")).alias("alike"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    left = texts.withColumnsRenamed({"digest": "a", "packed": "packed_a"})
    right = texts.withColumnsRenamed({"digest": "b", "packed": "packed_b"})
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def work(batch):
        unpack = zstandard.ZstdDecompressor().decompress
        first, second, packed_a, packed_b = lists(batch, "a", "b", "packed_a", "packed_b")
        out = {"a": [], "b": []}
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0))
        for a, b, x, y in zip(first, second, packed_a, packed_b):
            if known[0] != b:
                known = (b, shingle_set(unpack(y)))
            one, other = shingle_set(unpack(x)), known[1]
            common = len(np.intersect1d(one, other, assume_unique=True))
            if 100 * common >= percent * (len(one) + len(other) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(both, work, "a binary, b binary")


def shingle_counts(crowd: DataFrame) -> np.ndarray:
    """Shingles of the sets in each of BUCKETS buckets."""
    width = BUCKETS // BUCKET_ROWS

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(BUCKETS, np.int64)
        for batch in source:
            for packed in lists(batch, "packed")[0]:
                # a set's shingles are distinct, but two may fall into one bucket
                np.add.at(total, _bucket(shingle_set(unpack(packed))), 1)
        yield pa.record_batch([pa.array(range(BUCKET_ROWS), pa.int32()), pa.array(
            [row.tobytes() for row in total.reshape(-1, width)], pa.binary())], names=["part", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        every = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [every.tobytes()]})

    tasks = crowd.coalesce(crowd.count() // SETS_PER_TASK + 12)
    rows = tasks.mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    total = np.zeros((BUCKET_ROWS, width), np.int64)
    for part, counts in rows.collect():  # BUCKET_ROWS rows at every size
        total[part] = np.frombuffer(counts, np.int64)
    return np.minimum(total.ravel(), 2**32 - 1).astype(np.uint32)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> u64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


ENTRY = np.dtype([("root", "<i8"), ("n", "<i8"), ("left", "<i8"), ("digest", "V16")])


def prefixes(crowd: DataFrame, percent: int) -> DataFrame:
    """token, root, leads, entry: the shingles of each set that can be the rarest it shares with a similar one.

    ``leads`` marks those that can be so with a set of the same size or larger;
    in the entry, ``left`` counts the set's shingles from this one on.
    """
    shared = crowd.sparkSession.sparkContext.broadcast(shingle_counts(crowd))

    def work(batch):
        unpack, counts = zstandard.ZstdDecompressor().decompress, shared.value
        tokens, leads, entries = [], [], []
        for digest, root, packed in zip(*lists(batch, "digest", "root", "packed")):
            shingles = shingle_set(unpack(packed))
            n, often = len(shingles), counts[_bucket(shingles)]
            order = np.lexsort((shingles, often))
            left = np.arange(n, 0, -1)
            # no other set has the shingle of a bucket counted once
            use = (100 * left >= percent * n) & (often[order] > 1)
            entry = np.zeros(int(use.sum()), ENTRY)
            entry["root"], entry["n"], entry["left"], entry["digest"] = root, n, left[use], np.void(digest)
            tokens.append(signed(shingles[order][use]))
            leads.append((100 + percent) * left[use] >= 2 * percent * n)
            entries.append(entry)
        entries = np.concatenate(entries)
        return {"token": np.concatenate(tokens), "root": entries["root"].copy(), "leads": np.concatenate(leads),
                "entry": [x.tobytes() for x in entries]}

    return map_batches(crowd, work, "token long, root long, leads boolean, entry binary")


def crowded_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """a, b: every pair of sets (digest, packed, root) in different components that can be similar enough.

    Sets that share a shingle are compared in blocks.  A component with many of
    them has blocks of its own, which are not compared with each other.
    """
    rows = stage(prefixes(crowd, percent), "prefixes")
    each = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("own"), F.max("leads").alias("leads"))
    many = F.col("own") > BLOCK
    live = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("roots"), F.max("leads").alias("led"), F.sum(F.when(~many, F.col("own"))).alias("others"),
    ).where("roots > 1 and led").select("token", "others")
    crowds = each.where(many).select("token", "root", "own")
    slot = F.xxhash64("entry")
    blocks = rows.join(live, "token").join(crowds, ["token", "root"], "left").groupBy(
        "token", F.when(F.col("own").isNotNull(), F.col("root")).alias("only"),
        F.when(F.col("own").isNotNull(), F.pmod(slot, F.expr(f"own div {BLOCK} + 1"))).otherwise(
            F.pmod(slot, F.expr(f"others div {BLOCK} + 1"))).alias("block"),
    ).agg(F.collect_list("entry").alias("entries"), F.max("leads").alias("leads"))
    blocks = stage(blocks, "blocks")
    # the blocks of a frequent shingle meet in several tasks: each goes to one, its partners to all
    hot = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(f"n > {TASK_BLOCKS}").select(
        "token", F.expr(f"n div {TASK_BLOCKS} + 1").alias("ways"))
    dealt, ways = blocks.join(hot, "token", "left"), F.coalesce("ways", F.lit(1).cast("long"))
    one = dealt.where("leads").select("token", F.pmod(F.xxhash64("only", "block"), ways).alias("way"),
                                      F.col("only").alias("one_only"), F.col("entries").alias("one"))
    two = dealt.select("token", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"),
                       F.col("only").alias("two_only"), F.col("entries").alias("two"))
    both = one.join(two, ["token", "way"]).where(
        "one_only is null or two_only is null or one_only <> two_only").select("one", "two")

    def work(batch):
        out = {"a": [], "b": []}
        for x, y in zip(*lists(batch, "one", "two")):
            x, y = (np.frombuffer(b"".join(z), ENTRY) for z in (x, y))
            x = x[(100 + percent) * x["left"] >= 2 * percent * x["n"]][:, None]
            fit = (x["n"] <= y["n"]) & (100 * x["n"] >= percent * y["n"]) & (x["root"] != y["root"]) & (
                (100 + percent) * np.minimum(x["left"], y["left"]) >= percent * (x["n"] + y["n"]))
            for i, j in zip(*np.nonzero(fit)):
                ends = x["digest"][i, 0].tobytes(), y["digest"][j].tobytes()
                out["a"].append(min(ends))
                out["b"].append(max(ends))
        return out

    return map_batches(both, work, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, kept: one row per row of ``docs``."""
    likely = percent / 100 - 8 * (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5
    features = stage(set_features(docs), "features")
    sets = stage(features.where("digest is not null").groupBy("digest").agg(
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"),
        F.min(F.struct("doc_id", "tag")).alias("source")), "sets")
    nearest = stage(candidates(sets.withColumn("root", F.col("digest")), likely, True), "nearest")
    pairs, ends = nearest.where("b is not null"), nearest.where("b is null").select(F.col("a").alias("digest"))
    texts = stage(_texts_of(docs, sets.join(ends, "digest", "left_semi")), "texts")
    best = pairs.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("best")).select("a", "best.b").unionByName(
        pairs.groupBy("b").agg(F.max(F.struct("alike", "a")).alias("best")).select("best.a", "b")).distinct()
    of_set = _rooted(sets.select("digest", "least", F.col("digest").alias("root")),
                     stage(confirmed(best, texts, percent), "links"))
    # a set without an end row shares no first value with a set it can be linked with
    walked = stage(sets.select("digest", "signature", "sketch").join(ends, "digest", "left_semi").join(
        of_set.select("digest", "root"), "digest"), "walked")
    found = stage(candidates(walked, likely, False), "candidates")
    pairs, crowded = found.where("b is not null"), found.where(f"b is null and alike > {SPARE}").select("a")
    of_set = _rooted(of_set, stage(confirmed(pairs.join(best, ["a", "b"], "left_anti"), texts, percent), "links"))
    crowd = stage(texts.join(crowded, texts["digest"] == crowded["a"], "left_semi").join(of_set, "digest").select(
        "digest", "packed", F.xxhash64("root").alias("root")), "crowd")
    tried = pairs.select("a", "b").unionByName(best)
    apart = crowded_pairs(crowd, percent).join(tried, ["a", "b"], "left_anti")
    of_set = _rooted(of_set, stage(confirmed(apart, texts, percent), "links"))
    smallest = of_set.groupBy("root").agg(F.min("least").alias("component"))
    component = of_set.join(smallest, "root").select("digest", "component")
    return features.select("doc_id", "tag", "n_shingles", "digest").join(component, "digest", "left").select(
        "doc_id", "tag", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rooted(of_set: DataFrame, links: DataFrame) -> DataFrame:
    """digest, least, root of every set, after components that ``links`` connect have become one."""
    root = {end: of_set.select(F.col("digest").alias(end), F.col("root").alias(f"root_{end}")) for end in "ab"}
    joined = links.join(root["a"], "a").join(root["b"], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    roots = components(joined, "near").select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return stage(of_set.join(roots, "root", "left").select(
        "digest", "least", F.coalesce("new_root", "root").alias("root")), "roots")


def _texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """digest and compressed text of the document that stands for each set."""
    def work(batch):
        pack = zstandard.ZstdCompressor(level=1).compress
        ids, tags, texts = lists(batch, "doc_id", "tag", "text")
        return {"doc_id": ids, "tag": tags, "packed": [None if t is None else pack(t) for t in texts]}

    packed = map_batches(docs.select("doc_id", row_tag(), utf8()), work, "doc_id long, tag binary, packed binary")
    wanted = sets.select("digest", F.col("source.doc_id").alias("at_id"), F.col("source.tag").alias("at_tag"))
    return wanted.join(packed, packed["doc_id"].eqNullSafe(wanted["at_id"]) & (packed["tag"] == wanted["at_tag"])).select(
        "digest", "packed").dropDuplicates(["digest"])


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The document with the smallest doc_id of every group, with all columns of ``docs``.

    Rows with a null doc_id stay; repeated rows of one doc_id and text leave one.
    """
    kept = near_groups(docs, percent).where("kept and doc_id is not null").select("doc_id", "tag").distinct()
    tag, kept_id, kept_tag = spare(docs, "tag", "kept_id", "kept_tag")
    tagged = docs.withColumn(tag, row_tag())
    stay = tagged.where("doc_id is not null").join(
        kept.toDF(kept_id, kept_tag), (F.col("doc_id") == F.col(kept_id)) & (F.col(tag) == F.col(kept_tag)), "left_semi",
    ).dropDuplicates(["doc_id", tag])
    return stay.unionByName(tagged.where("doc_id is null")).drop(tag)
