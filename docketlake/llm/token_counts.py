"""Token counts of a unigram tokenizer, with forward scores shared along a trie.

The distinct pre-tokens of a batch are walked as a trie: in sorted order, the
path from the root to the current node is kept, and a pre-token only adds the
nodes below the prefix it shares with the one before.  A node's forward score is
the best sum of piece scores over all ways to cut its prefix; it depends on the
prefix alone and is computed once.  Terminal nodes store the token count.

Pre-tokens are the white-space words of the text, each led by the word mark.  A
character that no piece covers counts as its UTF-8 bytes.  Of equally good cuts
the one with fewer tokens counts.

A piece's score is its log probability.  The vocabulary's own numbers are the order
of its merges and no probabilities; these are estimated from all documents: every
task cuts its words with the tokenizer as it is and counts the pieces, and only
these counts, one for each piece, are added up.  Vocabulary and tokenizer stay as
they are.

Rows: a null or wordless text has no tokens.  Repeated rows are counted alike;
a word of any length is one pre-token.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import arrow_schema, lists, map_batches, utf8, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Words a worker counts before it cuts them, and counts it remembers between batches and tasks.
HELD, REMEMBERED = 300_000, 800_000
# What a worker process remembers of the job it works for.
_workers: dict = {}
# What every piece counts beyond its occurrences, so that unseen ones have a probability.
SMOOTHING = 0.5


def read_model(path: str = VOCABULARY) -> bytes:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()


def _tokenizer(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_counts(docs: DataFrame, model: bytes) -> dict[int, int]:
    """How often the tokenizer's own cuts of all words in ``docs`` have a piece, by its number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        total, words = np.zeros(tokenizer.get_piece_size(), np.int64), Counter()

        def add() -> None:
            cuts = tokenizer.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
            ids = np.fromiter((i for cut in cuts for i in cut), np.int64, int(sizes.sum()))
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
            np.add.at(total, ids, times)
            words.clear()

        for batch in batches:
            for text in lists(batch, "text")[0]:
                words.update(words_of(text))
                if len(words) > HELD:
                    add()
        add()
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], schema=schema)

    ddl = "piece int, n long"
    schema = arrow_schema(ddl)
    counted = docs.select(utf8()).mapInArrow(work, T.StructType.fromDDL(ddl)).groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in counted.collect()}  # a row for each piece of the vocabulary at most


def piece_scores(model: bytes, counts: dict[int, int]) -> tuple[dict[str, float], float]:
    """Log probability of every piece, and of one byte of a character that no piece covers."""
    tokenizer = _tokenizer(model)
    every = range(tokenizer.get_piece_size())
    in_bytes = [i for i in every if tokenizer.is_byte(i)]
    plain = [i for i in every if not (
        tokenizer.is_control(i) or tokenizer.is_unknown(i) or tokenizer.is_byte(i) or tokenizer.is_unused(i))]
    total = math.log(sum(counts.get(i, 0) + SMOOTHING for i in (*plain, *in_bytes)))
    scores = {tokenizer.id_to_piece(i): math.log(counts.get(i, 0) + SMOOTHING) - total for i in plain}
    byte = sum(counts.get(i, 0) + SMOOTHING for i in in_bytes) / max(1, len(in_bytes)) or SMOOTHING
    return scores, math.log(byte) - total


class PieceTrie:
    """Forward scores of prefixes; ``byte_score`` is what one byte of an uncovered character costs."""

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None):
        self.pieces = pieces
        # the longest piece that ends with a character
        self.longest: dict[str, int] = {}
        for piece in pieces:
            self.longest[piece[-1:]] = max(self.longest.get(piece[-1:], 0), len(piece))
        self.byte_score = min(pieces.values(), default=0.0) - 10 if byte_score is None else byte_score

    def counts(self, words: Iterable[str]) -> dict[str, tuple[int, float]]:
        """Token count and best score of every distinct word."""
        out: dict[str, tuple[int, float]] = {}
        pieces, longest = self.pieces, self.longest
        last, scores, tokens = "", [0.0], [0]
        for word in sorted(words):
            shared = len(commonprefix((last, word)))
            del scores[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best = fewest = None
                for start in range(max(0, end - longest.get(word[end - 1], 0)), end):
                    value = pieces.get(word[start:end])
                    if value is not None:
                        value += scores[start]
                        if best is None or value > best or value == best and tokens[start] + 1 < fewest:
                            best, fewest = value, tokens[start] + 1
                if best is None or word[end - 1] not in pieces:
                    size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    value = scores[end - 1] + size * self.byte_score
                    if best is None or value > best:
                        best, fewest = value, tokens[end - 1] + size
                scores.append(best)
                tokens.append(fewest)
            out[word] = tokens[-1], scores[-1]
            last = word
        return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, score (log probability of the best cuts) of every row.

    The vocabulary is read on the driver; its pieces, some ten thousand, go to
    the tasks with their scores, which are learned from ``docs``.
    """
    model = read_model(vocabulary)
    pieces = docs.sparkSession.sparkContext.broadcast(piece_scores(model, piece_counts(docs, model)))
    key = uuid.uuid4().hex

    def work(batch):
        if key not in _workers:
            _workers.clear()
            _workers[key] = PieceTrie(*pieces.value), {}
        trie, known = _workers[key]
        ids, texts = lists(batch, "doc_id", "text")
        words = [words_of(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*words) - known.keys()
        names = {MARK + w.decode("utf-8", "replace"): w for w in new}
        found = trie.counts(names)
        known.update((names[n], c) for n, c in found.items())
        for w in new - known.keys():  # bytes that decode alike
            known[w] = found[MARK + w.decode("utf-8", "replace")]
        out = {"doc_id": ids, "n_words": [len(w) for w in words], "n_tokens": [], "score": []}
        for w in words:
            cuts = [known[x] for x in w]
            out["n_tokens"].append(sum(c for c, _ in cuts))
            out["score"].append(float(sum(s for _, s in cuts)))
        return out

    return map_batches(docs.select("doc_id", utf8()), work, "doc_id long, n_words long, n_tokens long, score double")
