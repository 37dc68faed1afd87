"""Quality classifier by co-training on two views of a page.

One view is the text's content (which words occur), the other the page's
metadata (language, source, size and surface statistics).  Each has a classifier
of its own.  After every round each classifier labels all unlabelled documents
where it is confident, and the other learns from a draw of these pseudo-labels,
at a lower weight, in the next round.  The draw takes languages and sources in
turn, so that small ones are in it, and is another one in each round.  A
labelled document that one view rejects with confidence is explained: the other
view need not find a reason in it and leaves it out, and no view learns a
pseudo-label it is confident is wrong.  Both scores are calibrated on labelled
documents that neither has learned from; a document's score is the probability
that neither view has reason to reject it.  Of the rounds, the one counts that has
the least error on those documents, bad ones kept and good ones lost weighing alike
whatever their numbers.

Fitting uses at most ``labelled`` labelled documents, drawn by a hash, and for
each view at most ``pool`` newly labelled ones; giving pseudo-labels and scoring
read every document and its whole text.

Rows: a null text is empty, null language and source are values of their own,
rows with null labels are not learned from, of several labels of one document
the worse counts.  Repeated rows are scored alike.  Without labels of both kinds
every document gets the share of good labels (1 without any) as its score.
"""

from __future__ import annotations

import math
import operator
import pickle
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from docketlake.llm.common import WordHashes, lists, map_batches, row_tag, spare, stage

# Bounds of what is fitted on: labelled documents, newly labelled ones for each view and round; rounds.
LABELLED, POOL, ROUNDS = 8000, 3000, 3
# A pseudo-label is given where the calibrated probability is this near to 0 or 1.
CONFIDENT = 0.98
# Parts of a language and source in the draw of pseudo-labels, and the rows that may come from each; Spark applies
# limits of up to 1,000 before the shuffle.
SALTS, PART_ROWS = 8, 1000
# What a pseudo-label weighs, a label being 1.
PSEUDO_WEIGHT = 0.1
# Words in fewer sampled documents than this say nothing.
LEAST_DOCUMENTS = 5
LANGUAGES, SOURCES = 16, 32
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_hashes = WordHashes()


def content_words(text: bytes | None) -> set[bytes]:
    return set(text.translate(LOWER).split()) if text else set()


def metadata_features(text: bytes | None, lang: str | None, source: str | None) -> list[float]:
    """Surface statistics, then one position for the language and one for the source."""
    text = text or b""
    words = text.split()
    size, count = max(len(text), 1), max(len(words), 1)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    repeats = sum(map(operator.eq, words, islice(words, 1, None))) / count
    out = [
        1.0, math.log1p(len(text)), math.log1p(text.count(b"\n")), len(text) / count / 10,
        share(UPPER), math.sqrt(share(UPPER)), share(DIGITS), math.sqrt(share(DIGITS)), share(MARKS),
        math.sqrt(share(MARKS)), repeats, math.sqrt(repeats), len(set(words)) / count,
    ]
    one_hot = [0.0] * (LANGUAGES + SOURCES)
    one_hot[zlib.crc32(repr(lang).encode()) % LANGUAGES] = 1.0
    one_hot[LANGUAGES + zlib.crc32(repr(source).encode()) % SOURCES] = 1.0
    return out + one_hot


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(forward, backward, size: int, y: np.ndarray, rows: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Weights of a penalised logistic regression, by Adam on the whole sample; ``rows`` weighs the documents."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = backward(rows * (_sigmoid(forward(w)) - y)) / rows.sum() + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


@dataclass
class ContentView:
    """Word weights: logistic regression over words scaled by how unevenly the classes use them."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> ContentView:
        distinct, at, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]),
                                        return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        good = np.bincount(at, weights=y[rows], minlength=len(distinct))
        often = count >= LEAST_DOCUMENTS
        n_good, n_bad = y.sum(), len(y) - y.sum()
        ratio = np.log((good + 1) / (n_good + 2)) - np.log((count - good + 1) / (n_bad + 2))
        place = np.cumsum(often) - 1
        keep = often[at]
        rows, at = rows[keep], place[at[keep]]
        ratio, distinct = ratio[often], distinct[often]
        size = len(distinct)
        value = ratio[at]

        def forward(w):
            return np.bincount(rows, weights=value * w[at], minlength=len(sets)) + w[size]

        def backward(e):
            return np.append(np.bincount(at, weights=value * e[rows], minlength=size), e.sum())

        w = fit_logistic(forward, backward, size + 1, y, weight, 1e-4, 120)
        return cls(distinct, w[:size] * ratio, float(w[size]))

    def score(self, words: np.ndarray) -> float:
        if not len(self.words) or not len(words):
            return self.bias
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return float(self.weights[at][self.words[at] == words].sum() + self.bias)


@dataclass
class MetadataView:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> MetadataView:
        centre, scale = rows.mean(axis=0), rows.std(axis=0)
        centre[0], scale[0] = 0.0, 1.0
        scale = np.maximum(scale, 0.02)
        x = (rows - centre) / scale
        return cls(centre, scale, fit_logistic(lambda w: x @ w, lambda e: x.T @ e, x.shape[1], y, weight, 1e-3, 300))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) / self.scale) @ self.weights


def fit_line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a calibration, by Newton steps towards the labels pulled in a little."""
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * w), -5, 5)
    return np.array([max(w[0], 0.0), w[1]])


@dataclass
class Model:
    """Both views, their calibrations, and the share of good labels for when nothing was fitted."""

    content: ContentView | None = None
    metadata: MetadataView | None = None
    content_line: np.ndarray | None = None
    metadata_line: np.ndarray | None = None
    prior: float = 1.0

    def probabilities(self, words: list[np.ndarray], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good by the content, by the metadata, and by both."""
        if self.content is None:
            same = np.full(len(words), self.prior)
            return same, same, same
        one = np.array([self.content.score(w) for w in words]) * self.content_line[0] + self.content_line[1]
        two = self.metadata.score(meta) * self.metadata_line[0] + self.metadata_line[1]
        return _sigmoid(one), _sigmoid(two), _sigmoid(one) * _sigmoid(two)


Given = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def co_train(sets: list[np.ndarray], meta: np.ndarray, y: np.ndarray, held: np.ndarray, given: list[Given],
             explained: list[np.ndarray] | None = None) -> tuple[Model, list[np.ndarray] | None, float]:
    """One round; ``held`` marks the labelled rows kept for calibration.

    ``given`` has words, metadata and pseudo-labels that the content and the metadata view learn from;
    ``explained`` is what the round before has returned.  The last value is the error on the rows kept:
    the share of bad ones that pass plus the share of good ones that do not.
    """
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 1.0), None, 0.0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 2 == 0 if len(set(y[::2])) == len(set(y[1::2])) == 2 else np.ones(len(y), bool)
    own = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    kept = np.flatnonzero(held)
    explained = explained or [np.zeros(len(y), bool)] * 2  # for the content view, for the metadata view
    views, scores = [], []
    for view in (0, 1):
        learn = own[~explained[view][own]]
        if len(set(y[learn])) < 2:
            learn = own
        more_sets, more_meta, labels = given[view]
        target = np.append(y[learn], labels)
        weight = np.append(np.ones(len(learn)), np.full(len(labels), PSEUDO_WEIGHT))
        if view == 0:
            content = ContentView.fit([sets[i] for i in learn] + more_sets, target, weight)
            views.append(content)
            scores.append(np.array([content.score(s) for s in sets]))
        else:
            metadata = MetadataView.fit(np.vstack([meta[learn], more_meta]), target, weight)
            views.append(metadata)
            scores.append(metadata.score(meta))
    lines = []
    for view in (0, 1):
        use = kept[~explained[view][kept]]
        use = use if len(set(y[use])) == 2 else kept
        lines.append(fit_line(scores[view][use], y[use]))
    sure = [_sigmoid(z * line[0] + line[1]) for z, line in zip(scores, lines)]
    explained = [(y == 0) & (sure[1] <= 1 - CONFIDENT), (y == 0) & (sure[0] <= 1 - CONFIDENT)]
    keeps = sure[0] * sure[1] >= 0.5
    error = sum(float((keeps[kept] != y[kept])[y[kept] == kind].mean()) for kind in (0, 1) if (y[kept] == kind).any())
    return Model(views[0], views[1], *lines, prior=float(y.mean())), explained, error


def _confident(p: np.ndarray, other: np.ndarray) -> list[int | None]:
    """The label of rows one view is confident of, unless the other is as confident of the opposite."""
    good = (p >= CONFIDENT) & (other > 1 - CONFIDENT)
    bad = (p <= 1 - CONFIDENT) & (other < CONFIDENT)
    return [1 if g else 0 if b else None for g, b in zip(good, bad)]


def _features(docs: DataFrame) -> DataFrame:
    def work(batch):
        ids, tags, texts, langs, sources = lists(batch, "doc_id", "tag", "text", "lang", "source")
        return {
            "doc_id": ids, "tag": tags, "words": [_hashes.array(list(content_words(t))).tobytes() for t in texts],
            "meta": [np.array(metadata_features(*x)).tobytes() for x in zip(texts, langs, sources)],
        }

    return map_batches(_tagged(docs), work, "doc_id long, tag binary, words binary, meta binary")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"))


def _tagged(docs: DataFrame) -> DataFrame:
    return _columns(docs).withColumn("tag", row_tag())


def _drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of the id.

    The hash alone lets about twice as many pass, so that the task that puts them in
    order sees a bounded number whatever the table.
    """
    ids = stage(ids, "ids")
    share = min(1.0, 2 * most / max(1, ids.count()))
    hashed = F.xxhash64("doc_id")
    return ids.where(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy(
        F.pmod(hashed, F.lit(1 << 30)), "doc_id").limit(most)


def _in_turn(given: DataFrame, most: int, turn: int) -> DataFrame:
    """At most ``most`` rows of each view, languages and sources in turn, by a hash that differs from turn to turn.

    Ranks are first found in SALTS parts of a language and source, where a limit of
    PART_ROWS acts before the shuffle; then among the few rows left; and only as many
    ranks go into the last order as are needed.
    """
    hashed, group = F.xxhash64("doc_id", "tag", F.lit(turn)), ["view", "lang", "source"]
    cut = given.withColumn("draw", hashed).withColumn("salt", F.pmod(F.xxhash64("tag", "doc_id"), F.lit(SALTS)))
    order = ["draw", "doc_id", "tag"]
    inside = F.row_number().over(Window.partitionBy(*group, "salt").orderBy(*order))
    first = cut.withColumn("inside", inside).where(F.col("inside") <= min(most, PART_ROWS)).drop("inside", "salt")
    placed = stage(first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).select(
        "doc_id", "tag", "view", "good", "place", "draw"), "placed")
    chosen = []
    for view in (0, 1):
        mine, total, last = placed.where(F.col("view") == view), 0, 0
        # as many rows as there are ranks
        for row in mine.groupBy("place").count().orderBy("place").limit(most).collect():
            total, last = total + row["count"], row["place"]
            if total >= most:
                break
        chosen.append(mine.where(F.col("place") <= last).orderBy("place", *order).limit(most))
    return chosen[0].unionByName(chosen[1]).select("doc_id", "tag", "view", "good").distinct()


def newly_labelled(docs: DataFrame, known: DataFrame, model: Model, most: int, turn: int) -> DataFrame:
    """doc_id, tag, words, meta, good, view: of all documents not in ``known``, at most ``most`` for each view to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        ids, tags, texts, langs, sources = lists(batch, "doc_id", "tag", "text", "lang", "source")
        meta = np.array([metadata_features(*x) for x in zip(texts, langs, sources)])
        one, two, _ = shared.value.probabilities([_hashes.array(list(content_words(t))) for t in texts], meta)
        return {"doc_id": ids, "tag": tags, "lang": langs, "source": sources,
                "by_metadata": _confident(two, one), "by_content": _confident(one, two)}

    sure = map_batches(_tagged(docs.where("doc_id is not null")), work,
                       "doc_id long, tag binary, lang string, source string, by_metadata int, by_content int")
    # each view learns what the other has labelled
    labels = F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).alias("good")) for v, c in enumerate(("by_metadata", "by_content"))])
    given = stage(sure.where("by_metadata is not null or by_content is not null").join(known, "doc_id", "left_anti").select(
        "doc_id", "tag", "lang", "source", F.inline(labels)).where("good is not null"), "labelled")
    # bounded by ``most`` for each view
    chosen = F.broadcast(stage(_in_turn(given, most, turn), "drawn"))
    drawn = _tagged(docs).join(chosen.select("doc_id", "tag").distinct(), ["doc_id", "tag"], "left_semi")
    return _features(drawn).dropDuplicates(["doc_id", "tag"]).join(chosen, ["doc_id", "tag"])


def _fitting(explained: list[np.ndarray] | None):
    """A function that fits one round on the rows of the sample (view -1) and those newly labelled for each view."""
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "tag"])

        def part(view):
            rows = group[group["view"] == view]
            meta = np.array([np.frombuffer(m) for m in rows["meta"]])
            words = [np.sort(np.frombuffer(w, np.uint64)) for w in rows["words"]]
            return words, meta.reshape(len(rows), len(metadata_features(None, None, None))), rows["good"].to_numpy(float)

        held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in group["doc_id"][group["view"] == -1]], bool)
        return pd.DataFrame({"model": [pickle.dumps(co_train(*part(-1), held, [part(0), part(1)], explained))]})

    return fit


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> Model:
    """Fit the two views on bounded draws; documents are the ones in ``docs``, of which all not labelled get pseudo-labels."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(good)
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    # the drawn ids are bounded by the parameter
    chosen = F.broadcast(_drawn(ids.join(known, "doc_id"), labelled))
    # of different texts under one doc_id the one with the smallest digest counts
    found = _features(docs.join(chosen.select("doc_id"), "doc_id", "left_semi"))
    one = found.groupBy("doc_id").agg(F.min(F.struct("tag", "words", "meta")).alias("row")).select("doc_id", "row.*")
    sampled = stage(one.join(chosen, "doc_id").withColumn("view", F.lit(-1)), "sample")
    learned, model, explained, best = sampled, Model(), None, None
    for turn in range(1, rounds + 1):
        # what is learned from is bounded, so one task fits it; the driver only sees the weights
        fitted = learned.groupBy(F.lit("sample")).applyInPandas(_fitting(explained), "model binary").first()
        if fitted is None:
            return model
        model, explained, error = pickle.loads(fitted.model)
        # a round counts only where it does not make things worse on labels that nothing was learned from
        if best is None or error <= best[0]:
            best = error, model
        if explained is None or turn == rounds:
            return best[1]
        learned = sampled.unionByName(newly_labelled(docs, known, model, pool, turn))
    return best[1]


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tag, content_score, metadata_score, score, kept (score of at least one half) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        model = shared.value
        ids, tags, texts, langs, sources = lists(batch, "doc_id", "tag", "text", "lang", "source")
        meta = np.array([metadata_features(*x) for x in zip(texts, langs, sources)])
        one, two, both = model.probabilities([_hashes.array(list(content_words(t))) for t in texts], meta)
        return {"doc_id": ids, "tag": tags, "content_score": one, "metadata_score": two, "score": both, "kept": both >= 0.5}

    return map_batches(_tagged(docs), work, "doc_id long, tag binary, content_score double, metadata_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    names, hidden = docs.columns, spare(docs, "text_bytes", "lang_name", "source_name")

    def run(source):
        import pyarrow as pa

        model = shared.value
        for batch in source:
            if batch.num_rows:
                texts, langs, sources = lists(batch, *hidden)
                meta = np.array([metadata_features(*x) for x in zip(texts, langs, sources)])
                good = model.probabilities([_hashes.array(list(content_words(t))) for t in texts], meta)[2] >= 0.5
                yield batch.select(names).filter(pa.array(good))

    return docs.withColumns({
        hidden[0]: F.col("text").cast("binary"), hidden[1]: F.col("lang").cast("string"),
        hidden[2]: F.col("source").cast("string"),
    }).mapInArrow(run, schema)
