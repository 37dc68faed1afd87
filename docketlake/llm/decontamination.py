"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items of a block form one automaton.  Training words stream
through it; the state says how long the longest match ending at a word is, so a
window of an item that ends there is seen at once, at one step per word.

Rows: a null or wordless text has no words and no hits.  Items without words are
ignored, items without id are reported as ''.  Repeated rows are judged alike,
one result row for each; other columns of the documents are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import lists, map_batches, row_tag, spare, utf8

# Bytes of item text in one automaton (about a hundred times that in memory).
BLOCK_BYTES = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A-Z to lower case, every other ASCII byte outside a-z and 0-9 to a space; the
# bytes of other characters stay, and so does every position.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
NEVER = 1 << 60


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences.

    ``report_at[state]`` is the least match length at which the state ends an
    occurrence: of a window, or of a whole item shorter than a window.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [set()]
        whole: dict[int, set[str]] = {}
        for name, words in items:
            if not words:
                continue
            state, path = 0, []
            for word in words:
                state = self._extend(state, word)
                path.append(state)
            if len(words) < window:
                whole.setdefault(state, set()).add(name)
            self._mark(name, words)
        self._index(whole)

    def _state(self, length: int, link: int, step: dict) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the sequence at ``last`` followed by ``word``."""
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            known = self.step[last][word]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        return new

    def _split(self, last: int, word: bytes, known: int) -> int:
        """Give the sequences of ``known`` up to the length of ``last`` plus one a state of their own."""
        copy = self._state(self.length[last] + 1, self.link[known], dict(self.step[known]))
        self.items[copy] = set(self.items[known])
        self.link[known] = copy
        while last >= 0 and self.step[last].get(word) == known:
            self.step[last][word] = copy
            last = self.link[last]
        return copy

    def _mark(self, name: str, words: list[bytes]) -> None:
        """Note the item at every state that holds a part of it."""
        state = 0
        for word in words:
            state = self.step[state][word]
            up = state
            while up > 0 and name not in self.items[up]:
                self.items[up].add(name)
                up = self.link[up]

    def _index(self, whole: dict[int, set[str]]) -> None:
        count = len(self.link)
        self.found: list[set[str]] = [set()] * count    # items of the window that ends here
        self.short: list[tuple] = [()] * count          # (length, items) of whole short items that end here
        self.report_at = [NEVER] * count
        for state in sorted(range(1, count), key=self.length.__getitem__):
            link, length = self.link[state], self.length[state]
            if length >= self.window:
                inside = self.length[link] >= self.window
                self.found[state] = self.found[link] if inside else self.items[state]
                self.report_at[state] = self.window
            above = self.short[link]
            self.short[state] = ((length, whole[state]), *above) if state in whole else above
            if above:
                self.report_at[state] = 0
            elif state in whole:
                self.report_at[state] = min(length, self.report_at[state])

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as start, end, start, end, ... (merged), and the items found."""
        step, link, length, report_at = self.step, self.link, self.length, self.report_at
        spans: list[int] = []
        found: set[str] = set()
        state = matched = 0
        for at, word in enumerate(words):
            to = step[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state] + 1
            else:
                matched += 1
            state = to
            if matched >= report_at[state]:
                back = 0
                if matched >= self.window:
                    back = self.window
                    found |= self.found[state]
                for size, items in self.short[state]:
                    if size <= matched:
                        back = max(back, size)
                        found |= items
                if back:
                    start = at + 1 - back
                    while spans and start <= spans[-1]:
                        start = min(start, spans[-2])
                        del spans[-2:]
                    spans += (start, at + 1)
        return spans, found


_built: dict[str, Automaton] = {}


def _automaton(key: str, shared, window: int) -> Automaton:
    """Built once in a Python worker for each block of items."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, item_words(text)) for name, text in shared.value], window)
    return _built[key]


def merged_spans(spans: list[int]) -> list[int]:
    """Union of spans given as start, end, start, end, ..."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def scan_documents(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, tag, n_words, spans (word positions, merged) and items (sorted strings) of every document.

    Items are taken in blocks of about BLOCK_BYTES, so neither the driver nor a
    worker ever holds a larger benchmark than that; each block is one pass over
    the documents.  One block, the usual case, needs no shuffle.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), utf8()).where(
        "text is not null")
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    source = docs.select("doc_id", row_tag(), utf8())

    def pass_over(block: int) -> DataFrame:
        part = named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.name, bytes(r.text)) for r in part.collect()])
        key = uuid.uuid4().hex

        def work(batch):
            automaton = _automaton(key, shared, window)
            ids, tags, texts = lists(batch, "doc_id", "tag", "text")
            out = {"doc_id": ids, "tag": tags, "n_words": [], "spans": [], "items": []}
            for text in texts:
                words = item_words(text)
                spans, found = automaton.scan(words)
                out["n_words"].append(len(words))
                out["spans"].append(spans)
                out["items"].append(sorted(found))
            return out

        return map_batches(source, work, "doc_id long, tag binary, n_words long, spans array<long>, items array<string>")

    found = pass_over(0)
    if blocks == 1:
        return found
    every = found.withColumn("copies", F.lit(1))
    for block in range(1, blocks):
        every = every.unionByName(pass_over(block).where(F.size("items") > 0).withColumn("copies", F.lit(0)))
    joined = every.groupBy("doc_id", "tag").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("copies").cast("int").alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))

    def finish(batch):
        ids, tags, words, spans, names = lists(batch, "doc_id", "tag", "n_words", "spans", "items")
        return {"doc_id": ids, "tag": tags, "n_words": words, "spans": [merged_spans(s) for s in spans], "items": names}

    return map_batches(joined.drop("copies", "copy"), finish,
                       "doc_id long, tag binary, n_words long, spans array<long>, items array<string>")


def judged(scanned: DataFrame, one_in: int = 20) -> DataFrame:
    """Add n_hit and contaminated: at least one of ``one_in`` words is hit."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: x - total)
    # spans alternate start and end: end - (start - 0), then start - that, ... leaves the alternating sum
    return scanned.withColumn("n_hit", covered).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    out, last = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(text[last:at[start][0]])
        last = at[end - 1][1]
    return b"".join(out) + text[last:]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20,
                  longest: int | None = None) -> DataFrame:
    """Documents without contamination, with all their columns.

    A document at or above the coverage limit (one word in ``one_in``) goes.  With ``longest``,
    a shared span of more words than that is cut out of the documents that stay.
    Rows whose doc_id and text repeat share one fate.
    """
    def bounds(batch):
        ids, tags, spans = lists(batch, "doc_id", "tag", "spans")
        keep = [[v for s, e in zip(x[::2], x[1::2]) if e - s > longest for v in (s, e)] for x in spans]
        return {"doc_id": ids, "tag": tags, "spans": keep}

    verdict = judged(scan_documents(docs, items, window), one_in)
    tag, bad_id, bad_tag, cut_id, cut_tag, spans = spare(docs, "tag", "bad_id", "bad_tag", "cut_id", "cut_tag", "spans")
    bad = verdict.where("contaminated").select("doc_id", "tag").toDF(bad_id, bad_tag)
    tagged = docs.withColumn(tag, row_tag())
    kept = tagged.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(tag) == F.col(bad_tag)), "left_anti")
    if longest is None:
        return kept.drop(tag)
    cut = map_batches(verdict.where("not contaminated and size(spans) > 0").select("doc_id", "tag", "spans"), bounds,
                      "doc_id long, tag binary, spans array<long>").where("size(spans) > 0").dropDuplicates(
        ["doc_id", "tag"]).toDF(cut_id, cut_tag, spans)

    @F.udf("string")
    def cleaned(text, spans):
        return without_spans(text.encode(), spans).decode() if spans else text

    return kept.join(
        cut, F.col("doc_id").eqNullSafe(F.col(cut_id)) & (F.col(tag) == F.col(cut_tag)), "left",
    ).withColumn("text", cleaned("text", spans)).select(*docs.columns)
