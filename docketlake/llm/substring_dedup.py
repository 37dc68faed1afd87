"""Substring deduplication by compacting a de Bruijn graph of token windows.

Every window of ``length`` words is an edge of the graph.  A window's smallest
SEED-word hash is its anchor; consecutive windows of a document that share their
anchor form a nonbranching path, which travels as one row: anchor, hash of the
whole path, and its source coordinates (document, first window, windows).

* Anchors that occur once are dropped by a join: no window of theirs repeats.
* Equal paths (same anchor, same words) repeat as a whole; one join marks all
  their windows.
* Where different paths share an anchor the graph branches.  One copy of each
  such path is opened into its single windows, read again at its source
  coordinates, and the windows are matched one by one.

Marked windows go back to their documents by source coordinates and are joined
into long spans there.  Equality is 128 bits wide: 64 of the anchor, 64 of the
path or window.  Only repeated parts of a corpus ever travel as windows, and a
path that a third of all documents share is counted before the shuffle.

Rows: a null, empty or short text has no window and stays as it is.  Repeated
rows are occurrences of their own, so all windows of both go.  Rows with a null
doc_id take part.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import (
    WordHashes, gram_hashes, lists, map_batches, mixed, row_tag, signed, stage, u64, utf8, words_of,
)

SEED = 8
_hashes = WordHashes()


def _windows(texts: list[bytes | None], length: int):
    """All windows of a batch: document, position in it, anchor position, anchor hash, window hash.

    Positions of the batch are those of all its words one after the other;
    windows that would cross into the next document are left out.
    """
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return None
    hashes = _hashes.array([w for doc in words for w in doc])
    document = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[document] + at
    seed = gram_hashes(hashes, SEED, 1)
    order = mixed(seed, u64(7), 3)
    # leftmost position of the least order among the seeds of a window, by doubling
    inside = length - SEED + 1
    best, wide = np.arange(len(order)), 1
    while wide * 2 <= inside:
        best, wide = _smaller(order, best[:-wide], best[wide:]), wide * 2
    if wide < inside:
        best = _smaller(order, best[:len(best) - (inside - wide)], best[inside - wide:])
    anchor = best[start]
    return document, at, start, anchor, seed[anchor], gram_hashes(hashes, length, 2)[start]


def _smaller(order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(order[right] < order[left], right, left)


def path_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row per path: anchor, path (hash of all its words), doc_id, tag, span (first window * 64 + windows - 1)."""
    def work(batch):
        ids, tags, texts = lists(batch, "doc_id", "tag", "text")
        found = _windows(texts, length)
        if found is None:
            return {n: [] for n in ("anchor", "path", "doc_id", "tag", "span")}
        document, at, start, anchor, seed, window = found
        change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(document) != 0)) + 1
        head = np.concatenate(([0], change))
        tail = np.concatenate((change, [len(anchor)])) - 1
        # first and last window overlap and so hold every word of the path
        shape = ((anchor[head] - start[head]) * 64 + tail - head).astype(np.uint64)
        path = mixed(mixed(window[head], window[tail], 5), shape, 6)
        owner = document[head]
        return {
            "anchor": signed(seed[head]), "path": signed(path), "doc_id": [ids[i] for i in owner],
            "tag": [tags[i] for i in owner], "span": at[head] * 64 + tail - head,
        }

    return map_batches(docs.select("doc_id", row_tag(), utf8()), work,
                       "anchor long, path long, doc_id long, tag binary, span long")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, tag and the compressed text, for joins that move whole texts."""
    def work(batch):
        pack = zstandard.ZstdCompressor(level=1).compress
        ids, tags, texts = lists(batch, "doc_id", "tag", "text")
        return {"doc_id": ids, "tag": tags, "packed": [None if t is None else pack(t) for t in texts]}

    return map_batches(docs.select("doc_id", row_tag(), utf8()), work, "doc_id long, tag binary, packed binary")


def _unpacked(packed: list[bytes | None]) -> list[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if p is None else unpack(p) for p in packed]


def _with_texts(docs: DataFrame, details: DataFrame, how: str) -> DataFrame:
    """Join details (one row per document) to the compressed texts."""
    named = details.withColumnsRenamed({"doc_id": "at_id", "tag": "at_tag"})
    packed = _packed(docs)
    return packed.join(
        named, packed["doc_id"].eqNullSafe(named["at_id"]) & (packed["tag"] == named["at_tag"]), how,
    ).drop("at_id", "at_tag")


def opened_windows(docs: DataFrame, paths: DataFrame, length: int) -> DataFrame:
    """anchor, word_hash, doc_id, tag, at, many: the single windows of ``paths``.

    ``paths`` has anchor, doc_id, tag, span and many (the path itself repeats).
    """
    per_document = paths.groupBy("doc_id", "tag").agg(F.collect_list(
        F.struct("anchor", "span", "many")).alias("open")).select(
        "doc_id", "tag", F.col("open.anchor").alias("anchors"), F.col("open.span").alias("spans"),
        F.transform("open.many", lambda m: m.cast("int")).alias("many"))

    def work(batch):
        ids, tags, packed, anchors, spans, many = lists(batch, "doc_id", "tag", "packed", "anchors", "spans", "many")
        out = {n: [] for n in ("anchor", "word_hash", "doc_id", "tag", "at", "many")}
        for i, text in enumerate(_unpacked(packed)):
            grams = signed(gram_hashes(_hashes.array(words_of(text)), length, 2))
            for anchor, span, multiple in zip(anchors[i], spans[i], many[i]):
                at, count = span >> 6, (span & 63) + 1
                out["anchor"] += [anchor] * count
                out["word_hash"] += grams[at:at + count].tolist()
                out["doc_id"] += [ids[i]] * count
                out["tag"] += [tags[i]] * count
                out["at"] += range(at, at + count)
                out["many"] += [multiple] * count
        return out

    return map_batches(_with_texts(docs, per_document, "inner"), work,
                       "anchor long, word_hash long, doc_id long, tag binary, at long, many int")


def repeated_spans(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, tag, spans: first * 64 + count - 1 of runs of repeated windows, one row per document that has any."""
    if not SEED < length < SEED + 64:
        raise ValueError("length must be 9 to 71 words")
    paths = path_rows(docs, length)
    # written first: a join of two plain exchanges is one whose hot anchors Spark can split
    several = stage(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    # edges whose anchor occurs more than once; everything after this is about repeated text only
    edges = stage(path_rows(docs, length).join(several, "anchor", "left_semi"), "edges")
    # one source coordinate stands for all copies of a path
    graph = stage(edges.groupBy("anchor", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "span")).alias("source")), "graph")
    branching = stage(graph.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("paths")).where("paths > 1").select("anchor"), "branching")
    opened = stage(opened_windows(docs, graph.join(branching, "anchor", "left_semi").select(
        "anchor", "source.doc_id", "source.tag", "source.span", (F.col("n") > 1).alias("many")), length), "windows")
    matched = stage(opened.groupBy("anchor", "word_hash").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "matched")
    whole = edges.join(graph.where("n > 1").select("anchor", "path"), ["anchor", "path"], "left_semi").select(
        "doc_id", "tag", "span")
    parts = opened.where("many = 0").join(matched, ["anchor", "word_hash"], "left_semi").select(
        "doc_id", "tag", (F.col("at") * 64).alias("span"))
    return whole.unionByName(parts).groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))


def word_spans(spans: list[int] | None, length: int) -> list[list[int]]:
    """Merged [first word, end) of runs of windows."""
    out: list[list[int]] = []
    for span in sorted(spans or ()):
        first = span >> 6
        end = first + (span & 63) + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space, bytes) of every row."""
    def work(batch):
        ids, packed, spans = lists(batch, "doc_id", "packed", "spans")
        out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_text": []}
        for text, found in zip(_unpacked(packed), spans):
            words = words_of(text)
            count, last, kept = len(words), 0, []
            for first, end in word_spans(found, length):
                kept += words[last:first]
                last = end
            kept += words[last:]
            out["n_words"].append(count)
            out["n_removed"].append(count - len(kept))
            out["kept_text"].append(b" ".join(kept))
        return out

    return map_batches(_with_texts(docs, repeated_spans(docs, length), "left"), work,
                       "doc_id long, n_words long, n_removed long, kept_text binary")
