"""Spelling variants: words of a corpus that one edit turns into a more frequent word.

Words are points in the space of letter counts.  One edit adds a letter, takes one, or does both, so of two near words
one has at most one letter more and at most one less than the other.  The words of one length form a k-d tree; its
upper levels deal the words to cells, which are separate tasks, and inside a cell the tree goes on down to a few words.
A word is looked up in the tree of its own length and in that of the next one, and enters only boxes that are within
reach.  What is found is verified letter by letter.

Planes of the upper levels come from a sample, drawn by hash, of the lengths with more words than a cell holds.  They
decide how evenly the work is dealt; any planes give the same result.  A word goes to its own cell and to those
within reach, a number that grows with the square of the logarithm of the vocabulary.  Pairs are never written: a
cell returns each word's number of near words there and the best of them.

Defined results: null texts have no words, a null doc_id counts as an empty text, repeated rows count repeatedly,
words of any length are compared whole.  Words are held as one byte a letter (ISO 8859-1), whose order is that of
code points.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import arrow_schema, lists, stage, utf8

# A run is a misprint in a document when this divides its hash.
MISPRINT = 97
SHORTEST, LEAST = 5, 3
# A form is at least this many times as frequent as the word.
RATIO = 2
# Words of a cell, on average, and words of a box at the bottom of a cell's tree.
CELL, BOX = 8192, 16
# Sampled words of a cell, and of all cells together at most (cells grow beyond that).
SAMPLE_OF_CELL, SAMPLE = 64, 400_000
# Words a task counts before it hands them on.
HELD = 300_000

# Letters of words as ISO 8859-1 bytes; all others become blanks.
_LETTERS = frozenset(range(97, 123)) | frozenset(range(0xC0, 0x100))
_BLANKED = bytes(b if b in _LETTERS else 32 for b in range(256))
# The dimension of a letter: one for each of a to z, six for the others together.
DIMENSIONS = 32
_DIMENSION = np.array([b - 97 if 97 <= b < 123 else 26 + b % 6 for b in range(256)], np.int64)


def runs_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, one byte a letter."""
    if not text:
        return []
    letters = text.lower() if text.isascii() else text.lower().decode("utf-8", "replace").encode("latin-1", "replace")
    return letters.translate(_BLANKED).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n: how often each word stands in ``docs`` after misprints."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())]
            return pa.record_batch(columns, schema=schema)

        for batch in batches:
            for key, text in zip(*lists(batch, "key", "text")):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % MISPRINT == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= SHORTEST:
                        total[run] += n
                if len(total) > HELD:
                    yield handed_on()
                    total.clear()
        if total:
            yield handed_on()

    schema = arrow_schema("word binary, n long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    partial = docs.select(key, utf8()).mapInArrow(work, T.StructType.fromDDL("word binary, n long"))
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[bytes], length: int) -> np.ndarray:
    """A matrix of letters; all ``words`` have ``length`` letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def points_of(letters: np.ndarray) -> np.ndarray:
    """How often each dimension's letters stand in each word."""
    rows, length = letters.shape
    flat = _DIMENSION[letters] + np.arange(rows)[:, None] * DIMENSIONS
    counts = np.bincount(flat.ravel(), minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
    return counts.astype(np.int8 if length < 64 else np.int32)


def within(points: np.ndarray, low: np.ndarray, high: np.ndarray, down: int) -> np.ndarray:
    """Points from which at most one letter more and ``down`` letters less lead into the box."""
    more = np.maximum(low - points, 0).sum(axis=1, dtype=np.int32) <= 1
    return more & (np.maximum(points - high, 0).sum(axis=1, dtype=np.int32) <= down)


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension that varies most and its middle value; points up to it go left.  None if all are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    spread = points.var(axis=0) * (high > low)
    dimension = int(spread.argmax())
    if high[dimension] == low[dimension]:
        return None
    return dimension, min(int(np.median(points[:, dimension])), int(high[dimension]) - 1)


class Cells:
    """The upper levels of the tree of one length: space cut by planes, without bounds outside."""

    def __init__(self, sample: np.ndarray, cells: int):
        far = np.iinfo(np.int32).max // 4
        self.low, self.high, self.planes = [], [], []
        self.count = 0
        self._grow(sample, cells, np.full(DIMENSIONS, -far, np.int32), np.full(DIMENSIONS, far, np.int32))

    def _grow(self, sample: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.planes)
        self.low.append(low)
        self.high.append(high)
        self.planes.append(None)
        plane = _split(sample) if cells > 1 and len(sample) > 1 else None
        if plane is None:
            self.planes[at] = (-1, self.count, 0, 0)
            self.count += 1
            return at
        dimension, value = plane
        left = sample[:, dimension] <= value
        share = max(1, min(cells - 1, round(cells * left.mean())))
        below, above = high.copy(), low.copy()
        below[dimension], above[dimension] = value, value + 1
        one = self._grow(sample[left], share, low, below)
        two = self._grow(sample[~left], cells - share, above, high)
        self.planes[at] = (dimension, value, one, two)
        return at

    def own(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        cell = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            dimension, value, one, two = self.planes[at]
            if dimension < 0:
                cell[rows] = value
            elif len(rows):
                left = points[rows, dimension] <= value
                todo += [(one, rows[left]), (two, rows[~left])]
        return cell

    def reached(self, points: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the cells within their reach."""
        found = []
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            rows = rows[within(points[rows], self.low[at], self.high[at], down)]
            dimension, value, one, two = self.planes[at]
            if dimension < 0:
                found.append((rows, np.full(len(rows), value, np.int64)))
            elif len(rows):
                todo += [(one, rows), (two, rows)]
        return tuple(np.concatenate(c) for c in zip(*found))


def planes(words: DataFrame) -> dict[int, Cells]:
    """Cells of the lengths with more than CELL words; each other length is one cell."""
    many = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > CELL).collect()
    if not many:
        return {}
    total = sum(row["count"] for row in many)
    per_cell = max(CELL, -(-total * SAMPLE_OF_CELL // SAMPLE))
    part = min(1.0, SAMPLE_OF_CELL / per_cell)
    cells = {row["length"]: -(-row["count"] // per_cell) for row in many}
    drawn = words.where(F.length("word").isin(list(cells)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part * (1 << 20))))
    sample = defaultdict(list)
    for row in drawn.select("word").toLocalIterator():  # at most some SAMPLE words, by the share above
        sample[len(row["word"])].append(bytes(row["word"]))
    return {length: Cells(points_of(letters_of(sample[length], length)), n) for length, n in cells.items() if sample[length]}


def routed(words: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """length, cell, own, word, n: every word in its cell, and as a visitor in the cells within its reach.

    Of two cells of one length that reach each other, the words of the first visit the second.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = defaultdict(list)
            for word, n in zip(*lists(batch, "word", "n")):
                groups[len(word)].append((word, n))
            for length, rows in groups.items():
                names, counts = pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())
                points = points_of(letters_of([r[0] for r in rows], length))
                every, nowhere = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                same, longer = trees.get(length), trees.get(length + 1)
                own = same.own(points) if same else nowhere
                visits = [(length, every, own, True)]
                if same:
                    at, cell = same.reached(points, 1)
                    later = cell > own[at]
                    visits.append((length, at[later], cell[later], False))
                visits.append((length + 1, *(longer.reached(points, 0) if longer else (every, nowhere)), False))
                for target, at, cell, mine in visits:
                    take = pa.array(at)
                    yield pa.record_batch([
                        pa.array(np.full(len(at), target), pa.int32()), pa.array(cell, pa.int32()),
                        pa.array(np.full(len(at), mine)), names.take(take), counts.take(take)], schema=schema)

    ddl = "length int, cell int, own boolean, word binary, n long"
    schema = arrow_schema(ddl)
    return words.select("word", "n").mapInArrow(work, T.StructType.fromDDL(ddl))


def _replaced(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left != right).sum(axis=1) == 1


def _inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether one letter put into ``short`` gives ``long``."""
    length = short.shape[1]
    head, tail = short == long[:, :length], short == long[:, 1:]
    same = np.where(head.all(axis=1), length, head.argmin(axis=1))
    return (tail | (np.arange(length) < same[:, None])).all(axis=1)


def box_search(points: np.ndarray, visitors: np.ndarray, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, point) numbers with at most one letter more and ``down`` less between them, by a tree over the points."""
    todo = [(np.arange(len(points)), np.arange(len(visitors)))]
    while todo:
        mine, guests = todo.pop()
        inside = points[mine]
        guests = guests[within(visitors[guests], inside.min(axis=0), inside.max(axis=0), down)]
        if not len(guests):
            continue
        plane = _split(inside) if len(mine) > BOX else None
        if plane is not None:
            left = inside[:, plane[0]] <= plane[1]
            todo += [(mine[left], guests), (mine[~left], guests)]
            continue
        # lengths differ by a fixed amount, so a bound on the letters more bounds the letters less
        room = max(1, (1 << 24) // (len(mine) * DIMENSIONS))
        for start in range(0, len(guests), room):
            some = guests[start:start + room]
            more = np.maximum(inside[None] - visitors[some][:, None], 0).sum(axis=2, dtype=np.int32)
            at, to = np.nonzero(more <= 1)
            yield some[at], mine[to]


def _search(cell: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of every word with near words in this cell, counted on both sides."""
    own = np.array(cell.column("own").to_numpy(), bool)
    words, counts = cell.column("word").to_pylist(), cell.column("n").to_numpy().astype(np.int64)
    length = cell.column("length")[0].as_py()
    sizes = np.array([len(w) for w in words])
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    # place in the order of falling frequency, then code points
    order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])), np.int64)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    here = np.flatnonzero(own)
    letters = letters_of([words[i] for i in here], length)
    points = points_of(letters)
    for size, verify in ((length, _replaced), (length - 1, _inserted)):
        coming = np.flatnonzero(sizes == size)
        if size == 0 or not len(coming) or not len(here):
            continue
        coming_letters = letters_of([words[i] for i in coming], size)
        guests = points_of(coming_letters).astype(points.dtype)
        for a, b in box_search(points, guests, 1 if size == length else 0):
            good = verify(coming_letters[a], letters[b])
            # pairs inside the cell are met from both ends
            good &= ~own[coming[a]] | (coming[a] < here[b])
            one, two = coming[a[good]], here[b[good]]
            for target, other in ((one, two), (two, one)):
                np.add.at(near, target, 1)
                np.minimum.at(best, target, place[other])
    found = np.flatnonzero(near)
    chosen = order[best[found]]
    return pa.table({
        "word": pa.array([words[i] for i in found], pa.binary()), "n_near": pa.array(near[found], pa.int64()),
        "best_n": pa.array(counts[chosen], pa.int64()), "best": pa.array([words[i] for i in chosen], pa.binary())})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of n and word) of every word in ``words`` (word, n) that has near words."""
    trees = planes(words)
    # little to read and much to search: tasks of a few cells, whatever their bytes
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(t.count for t in trees.values()) // 2)
    cells = routed(words, trees).repartition(tasks, "length", "cell").groupBy("length", "cell").applyInArrow(
        _search, "word binary, n_near long, best_n long, best binary")
    return cells.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: ``links`` (word, form) followed to their ends by doubling.

    Frequency doubles with every link, so there are no rings, and a chain of n links
    is at its end after log2(n) rounds.  Words without a form have no row.
    """
    ends = stage(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stage(ends.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        ends = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return ends


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text) frequent enough."""
    words = stage(word_counts(docs).where(F.col("n") >= LEAST), "words")
    best_n = -F.col("best.n")
    judged = stage(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(best_n >= RATIO * F.col("n"), F.col("best.word")).alias("form"),
        F.when(best_n >= RATIO * F.col("n"), best_n).alias("form_n")), "judged")
    ends = roots(judged.where("form is not null").select("word", "form"))

    def text(name: str):
        return F.decode(name, "ISO-8859-1").alias(name)

    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select(
        text("word"), text("form"), text("root"), "n", "n_near", "form_n")
