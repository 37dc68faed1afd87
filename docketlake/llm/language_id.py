"""Language of texts by a small convolutional network over bytes.

A text is cut into windows of fixed length.  Every byte becomes a short learned vector, filters of several widths run
over the window, each filter's largest answer is kept, and a softmax over these gives the languages.  The answer for a
text is the mean of its windows' probabilities, so all of it counts, and no other column is read.

The network is trained in numpy, in one task, on a bounded draw: at most WINDOWS windows in all, as many of one
language as of another, drawn by hash from all labelled texts and at most four from one text.  The draw does not
depend on how rows are dealt to tasks and training is seeded, so a repeated task gives the same network up to
rounding.  The weights (some 60 KB) are what the driver passes on.

Defined results: a text that is null or without letters is ``und`` with score 0, as is every text when nothing can be
learned from.  Repeated rows are scored each.  Any length is read whole, in blocks of windows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docketlake.llm.common import arrow_schema, lists, map_batches, utf8

UNKNOWN = "und"
# Bytes of a window, windows learned from in all, and of one text at most.
SIZE, WINDOWS, OF_TEXT = 192, 8000, 4
WIDTHS, FILTERS, DEPTH = (2, 4, 6), 16, 8
EPOCHS, BATCH, RATE = 8, 32, 0.004
# Windows a worker holds as floats at a time.
BLOCK = 32
FOLDS, HELD_OUT = 3, 1

_letter = re.compile(r"[^\W\d_]")


def fold(doc_id: Column) -> Column:
    """The fold of a document; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def has_letter(text: bytes | None) -> bool:
    return bool(text) and _letter.search(text.decode("utf-8", "replace")) is not None


def cut(text: bytes) -> np.ndarray:
    """Windows of a text (windows, SIZE): one after the other, the last one ends with the text; a short text is filled up."""
    values = np.frombuffer(text, np.uint8)
    if len(values) <= SIZE:
        return np.concatenate([values, np.zeros(SIZE - len(values), np.uint8)])[None]
    whole = values[:len(values) // SIZE * SIZE].reshape(-1, SIZE)
    return whole if len(values) % SIZE == 0 else np.concatenate([whole, values[None, -SIZE:]])


class ByteNet:
    """Embedding, filters of several widths, largest answers, softmax."""

    def __init__(self, weights: dict[str, np.ndarray], languages: list[str]):
        self.weights, self.languages = weights, languages

    @classmethod
    def fresh(cls, languages: list[str], random: np.random.Generator) -> ByteNet:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return random.normal(0, scale, shape).astype(np.float32)

        weights = {"bytes": normal(256, DEPTH, scale=0.5)}
        for width in WIDTHS:
            weights[f"filter{width}"] = normal(width * DEPTH, FILTERS, scale=(width * DEPTH) ** -0.5)
            weights[f"bias{width}"] = np.zeros(FILTERS, np.float32)
        weights["out"] = normal(len(WIDTHS) * FILTERS, len(languages), scale=0.1)
        weights["shift"] = np.zeros(len(languages), np.float32)
        return cls(weights, languages)

    def answers(self, vectors: np.ndarray, width: int) -> np.ndarray:
        """Answers of the filters of one width at every place (windows, places, FILTERS)."""
        places = vectors.shape[1] - width + 1
        step, along, deep = vectors.strides
        runs = np.lib.stride_tricks.as_strided(
            vectors, (len(vectors), places, width * DEPTH), (step, along, deep), writeable=False)
        flat = np.ascontiguousarray(runs).reshape(-1, width * DEPTH)
        return (flat @ self.weights[f"filter{width}"]).reshape(len(vectors), places, FILTERS)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Largest answers, where they stand, and the vectors of the bytes."""
        vectors = self.weights["bytes"][windows]
        largest, places = [], []
        for width in WIDTHS:
            answers = self.answers(vectors, width)
            at = answers.argmax(axis=1)
            places.append(at)
            largest.append(np.take_along_axis(answers, at[:, None], 1)[:, 0] + self.weights[f"bias{width}"])
        return np.maximum(np.concatenate(largest, axis=1), 0), places, vectors

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of windows, block by block."""
        out = []
        for start in range(0, len(windows), BLOCK):
            vectors = self.weights["bytes"][windows[start:start + BLOCK]]
            hidden = np.concatenate([
                self.answers(vectors, w).max(axis=1) + self.weights[f"bias{w}"] for w in WIDTHS], axis=1)
            out.append(softmax(np.maximum(hidden, 0) @ self.weights["out"] + self.weights["shift"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; through the largest answers only."""
        weights = self.weights
        hidden, places, vectors = self.pooled(windows)
        wrong = softmax(hidden @ weights["out"] + weights["shift"])
        wrong[np.arange(len(labels)), labels] -= 1
        wrong /= len(labels)
        found = {"out": hidden.T @ wrong, "shift": wrong.sum(axis=0), "bytes": np.zeros_like(weights["bytes"])}
        back = (wrong @ weights["out"].T) * (hidden > 0)
        rows = np.arange(len(windows))[:, None, None]
        for i, width in enumerate(WIDTHS):
            mine = back[:, i * FILTERS:(i + 1) * FILTERS]
            spots = places[i][:, :, None] + np.arange(width)  # windows, filters, width
            runs = vectors[rows, spots].reshape(len(windows), FILTERS, -1)
            found[f"filter{width}"] = np.einsum("nf,nfk->kf", mine, runs)
            found[f"bias{width}"] = mine.sum(axis=0)
            to_bytes = (mine[:, :, None] * weights[f"filter{width}"].T[None]).reshape(-1, DEPTH)
            np.add.at(found["bytes"], windows[rows, spots].ravel(), to_bytes)
        return found

    def learn(self, windows: np.ndarray, labels: np.ndarray, random: np.random.Generator) -> None:
        """Adam over shuffled batches.  A third of the windows is shortened, so that short texts are known too."""
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps, last = 0, max(1, EPOCHS * -(-len(windows) // BATCH))
        for _ in range(EPOCHS):
            order = random.permutation(len(windows))
            for start in range(0, len(order), BATCH):
                rows = order[start:start + BATCH]
                batch = windows[rows].copy()
                for i in np.flatnonzero(random.random(len(rows)) < 1 / 3):
                    batch[i, random.integers(6, SIZE):] = 0
                steps += 1
                rate = RATE * (1 - 0.9 * steps / last)
                for name, slope in self.gradients(batch, labels[rows]).items():
                    mean[name] += 0.1 * (slope - mean[name])
                    square[name] += 0.001 * (slope * slope - square[name])
                    size = np.sqrt(square[name] / (1 - 0.999 ** steps)) + 1e-8
                    self.weights[name] -= (rate * (mean[name] / (1 - 0.9 ** steps)) / size).astype(np.float32)

    def language(self, text: bytes | None) -> tuple[str, float]:
        """The language of a whole text and its mean probability."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        mean = self.probabilities(cut(text)).mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        return self.languages[best], float(min(1.0, max(0.0, mean[best])))


def softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def loads(data: bytes, languages: list[str]) -> ByteNet:
    with np.load(io.BytesIO(data)) as stored:
        return ByteNet({name: stored[name] for name in stored.files}, languages)


def draw(labelled: DataFrame, most: int = WINDOWS) -> DataFrame:
    """lang, window: at most ``most`` windows, an equal number of each language where there are enough.

    A text's chance depends on its hash alone.  Twice the wanted number passes on average,
    so that the ranking by language sees a bounded number of rows, whatever the table.
    """
    texts = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text")
    counts = texts.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return texts.sparkSession.createDataFrame([], "lang string, window binary")
    each = max(1, most // len(counts))
    chance = F.lit(0.0)
    for row in counts:
        chance = F.when(F.col("lang") == row["lang"], min(1.0, 2 * each / row["count"])).otherwise(chance)
    chosen = texts.withColumn("at", F.xxhash64("text", F.lit(13))).where(F.pmod("at", F.lit(1 << 30)) / F.lit(1 << 30) < chance)

    def work(batch: pa.RecordBatch) -> dict:
        out = {"lang": [], "place": [], "window": []}
        for lang, at, text in zip(*lists(batch, "lang", "at", "text")):
            windows = cut(text)
            random = np.random.default_rng(at & 0xFFFFFFFF)
            for turn, i in enumerate(random.permutation(len(windows))[:OF_TEXT] if has_letter(text) else ()):
                out["lang"].append(lang)
                out["place"].append(turn * 2.0 + random.random())
                out["window"].append(windows[i].tobytes())
        return out

    windows = map_batches(chosen.select("lang", "at", utf8()), work, "lang string, place double, window binary")
    # copies of a text count once; first windows of all texts come before second ones
    first = windows.distinct().groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "window"))).alias("all"))
    return first.select("lang", F.explode(F.slice("all", 1, each)).alias("one")).select("lang", "one.window")


def train(labelled: DataFrame, most: int = WINDOWS) -> ByteNet:
    """A network that knows the languages in ``labelled`` (text, lang)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, window) for batch in batches for lang, window in zip(*lists(batch, "lang", "window")))
        if not rows:
            return
        languages = sorted({lang for lang, _ in rows})
        labels = np.array([languages.index(lang) for lang, _ in rows])
        windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, SIZE)
        random = np.random.default_rng(20)
        net = ByteNet.fresh(languages, random)
        net.learn(windows, labels, random)
        data = io.BytesIO()
        np.savez(data, **net.weights)
        yield pa.record_batch([pa.array([data.getvalue()]), pa.array([languages])], schema=schema)

    ddl = "weights binary, languages array<string>"
    schema = arrow_schema(ddl)
    fitted = draw(labelled, most).repartition(1).mapInArrow(work, T.StructType.fromDDL(ddl)).collect()
    return loads(bytes(fitted[0]["weights"]), list(fitted[0]["languages"])) if fitted else ByteNet({}, [])


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text); only the text is looked at."""
    def work(batch: pa.RecordBatch) -> dict:
        ids, texts = lists(batch, "doc_id", "text")
        found = [net.language(text) for text in texts]
        return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(docs.select("doc_id", utf8()), work, "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of ``docs`` that are not held out."""
    net = train(docs.where(fold(F.col("doc_id")) != HELD_OUT).select("text", "lang"))
    return identify(docs, net).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")
