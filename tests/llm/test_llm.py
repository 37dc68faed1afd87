"""Operators for training data against brute force, and on awkward rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketlake.llm import (
    components, decontamination, exact_dedup, lm_scoring, mixing, near_dedup, quality, sharding, substring_dedup,
    token_counts, url_filter,
)
from docketlake.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (5, "other words here"), (None, "no id"),
    (None, None), (6, LONG), (7, LONG), (8, "ÄÖ é ñ 漢字 " * 20), (9, "ÄÖ é ñ 漢字 " * 20), (10, "x" * 5000),
]


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame(
        [(i, t, None if t is None else "en", None if i is None else f"s{i % 3}", None) for i, t in rows], SCHEMA)


def sentences(seed, count, length=60, vocabulary=400):
    rng = random.Random(seed)
    return [[f"t{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(rng.randint(5, length))] for _ in range(count)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with exact copies, near copies, shared passages and awkward rows."""
    texts = [" ".join(w) for w in sentences(3, 40, 120)]
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = list(enumerate(texts, 100))
    rows += [(200 + i, f"{texts[i]} {passage} {texts[i + 1]}") for i in range(6)]
    for i in range(30):
        words = ("k%d " * 80 % tuple(range(80))).split()
        words[rng.randrange(80)] = f"z{i}"
        rows.append((300 + i, " ".join(words)))
    rows += [(400 + i, texts[0].replace(" ", "  ")) for i in range(5)]
    return rows + AWKWARD


def split_words(text):
    return [w for w in (text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# 1 -----------------------------------------------------------------------------------------------

def normal_words(text):
    return "".join(
        c if c.isascii() and (c.islower() or c.isdigit()) or not c.isascii() else " " for c in lowered(text)).split(" ")


def windows_of(items, size):
    out = defaultdict(set)
    for name, text in items:
        words = [w for w in normal_words(text) if w]
        if words:
            n = min(size, len(words))
            for i in range(len(words) - n + 1):
                out[tuple(words[i:i + n])].add(str(name))
    return out


def brute_contamination(rows, items, size=13):
    windows = windows_of(items, size)
    out = Counter()
    for doc_id, text in rows:
        words = [w for w in normal_words(text) if w]
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                names = windows.get(tuple(words[i:i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out[doc_id, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)] += 1
    return out


def scanned(df):
    rows = decontamination.judged(df).collect()
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 150])
def test_contamination(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = [(1, corpus[2][1]), (2, corpus[3][1][:60]), (3, "One"), (4, None), (5, "  "), (10, "no id"),
             (11, " ".join(f"p{i}" for i in range(10, 40))), (12, "p20 p21 p22")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert scanned(decontamination.scan_documents(frame(spark, corpus), table)) == brute_contamination(corpus, items)


def test_contamination_random(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(150)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert scanned(decontamination.scan_documents(frame(spark, rows), table, 6)) == brute_contamination(rows, items, 6)


def test_spans_are_cut_and_documents_go(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(500))
    docs = frame(spark, [(1, f"{filler}, {passage}; end"), (2, passage), (3, "clean"), (None, None)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert set(kept) == {1, 3, None} and passage in kept[1]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, longest=15).collect()}
    assert cut == {1: f"{filler}, ; end", 3: "clean", None: None}


# 2 -----------------------------------------------------------------------------------------------

def brute_repeats(rows, length):
    starts = Counter()
    for _, text in rows:
        words = split_words(text)
        starts.update(tuple(words[i:i + length]) for i in range(len(words) - length + 1))
    out = Counter()
    for doc_id, text in rows:
        words, gone = split_words(text), set()
        for i in range(len(words) - length + 1):
            if starts[tuple(words[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        out[doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    return out


def repeats(df, length):
    return Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text).decode())
                   for r in substring_dedup.remove_repeats(df, length).collect())


def test_repeated_spans(spark, corpus):
    assert repeats(frame(spark, corpus), 35) == brute_repeats(corpus, 35)


@pytest.mark.parametrize("letters", [2, 5])
def test_repeats_in_dense_text(spark, letters):
    rng = random.Random(letters)
    rows = [(i, " ".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    assert repeats(frame(spark, rows), 10) == brute_repeats(rows, 10)


# 3 -----------------------------------------------------------------------------------------------

def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(split_words(text))].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = Counter()
    for doc_id, text in rows:
        group = groups["".join(split_words(text))]
        keep = min(group)
        keep_id = None if keep[1] else keep[2]
        out[doc_id, keep_id, len(group), doc_id == keep_id] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_exact_copies(spark, corpus, digest):
    found = exact_dedup.find_copies(frame(spark, corpus), digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute_copies(corpus)


def test_exact_dedup_keeps_columns(spark, corpus):
    docs = frame(spark, corpus)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = ["".join(split_words(r.text)) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({"".join(split_words(t)) for _, t in corpus})


# 4 -----------------------------------------------------------------------------------------------

def shingles(text):
    words = split_words(lowered(text))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        component = doc_id if not sets[i] else least.get(find(i))
        out[doc_id, len(sets[i]), component, doc_id == component] += 1
    return out


def test_near_copies(spark, corpus):
    found = near_dedup.near_groups(frame(spark, corpus)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_near(corpus)


def test_near_dedup_leaves_one(spark, corpus):
    docs = frame(spark, corpus)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    want = [d for d, _, _, keep in brute_near(corpus).elements() if keep and d is not None]
    ids = [r.doc_id for r in kept.collect()]
    assert set(want) == {i for i in ids if i is not None}
    assert ids.count(None) == 2


@pytest.mark.parametrize("block, task_blocks", [(near_dedup.BLOCK, near_dedup.TASK_BLOCKS), (30, 3)])
def test_near_copies_in_a_template_crowd(spark, monkeypatch, block, task_blocks):
    """Hundreds of sets just below the limit among themselves, and pairs of them above it."""
    template = [f"c{i}" for i in range(204)]
    rows = []
    for i in range(600):
        # 200 shingles of the template and 22 others: 0.82; a pair shares 12 of the others: 0.91
        pair = i // 2 if i < 160 else -i
        own = [f"p{pair}_{j}" for j in range(12)] + [f"o{i}_{j}" for j in range(10)]
        rows.append((i, " ".join(template + own)))
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TASK_BLOCKS", task_blocks)
    found = near_dedup.near_groups(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_near(rows)
    assert sum(not r.kept for r in found) == 80


def test_candidates_between_components_only(spark):
    """Sets of one root make no pair; the first walk names at most one set before each in each order."""
    rows = [(i, " ".join([f"w{j}" for j in range(150)] + [f"own{i}"])) for i in range(60)]
    sets = near_dedup.stage(near_dedup.set_features(frame(spark, rows)), "sets")
    one = near_dedup.candidates(sets.withColumn("root", F.lit(b"x")), 0.5, False).where("b is not null")
    assert one.count() == 0
    apart = sets.withColumn("root", F.col("digest"))
    every = {(r.a, r.b) for r in near_dedup.candidates(apart, 0.5, False).where("b is not null").collect()}
    near = near_dedup.candidates(apart, 0.5, True).collect()
    named = {(r.a, r.b) for r in near if r.b is not None}
    assert named <= every and 0 < len(named) <= near_dedup.TREES * len(rows)
    # every set has candidates here, so the second walk reads them all
    assert len({r.a for r in near if r.b is None}) == len(rows)
    two = sets.withColumn("root", F.when(F.col("doc_id") % 2 == 0, F.lit(b"x")).otherwise(F.lit(b"y")))
    odd = {r.digest: r.doc_id % 2 for r in sets.collect()}
    across = {(r.a, r.b) for r in near_dedup.candidates(two, 0.5, False).where("b is not null").collect()}
    assert across == {(a, b) for a, b in every if odd[a] != odd[b]}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


# 5 -----------------------------------------------------------------------------------------------

def brute_cut(word, pieces, byte_score):
    best = (-math.inf, 0)
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        score = tokens = 0
        for p in parts:
            if p in pieces:
                score, tokens = score + pieces[p], tokens + 1
            elif len(p) == 1:
                score, tokens = score + len(p.encode()) * byte_score, tokens + len(p.encode())
            else:
                break
        else:
            best = max(best, (score, -tokens))
    return -best[1], best[0]


def test_forward_scores():
    rng = random.Random(7)
    pieces = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))): -rng.randint(1, 9) / 2 for _ in range(25)}
    trie = token_counts.PieceTrie(pieces, -6.0)
    words = {"".join(rng.choice("abéx") for _ in range(rng.randint(1, 9))) for _ in range(200)}
    assert trie.counts(words) == {w: brute_cut(w, pieces, -6.0) for w in words}


def plain_cut(word, pieces, byte_score):
    """Best cut of one word, without sharing anything: (tokens, score)."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[start][0] + pieces[word[start:end]], best[start][1] - 1)
                for start in range(max(0, end - 48), end) if word[start:end] in pieces]
        if word[end - 1] not in pieces:
            size = len(word[end - 1].encode())
            ways.append((best[end - 1][0] + size * byte_score, best[end - 1][1] - size))
        best.append(max(ways))
    return -best[-1][1], best[-1][0]


def test_token_counts(spark, corpus):
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY)
    words, counts = Counter(w for _, t in corpus for w in split_words(t)), Counter()
    for word, n in words.items():
        for piece in tokenizer.encode(word):
            counts[piece] += n
    model = token_counts.read_model()
    docs = frame(spark, corpus).repartition(5)
    assert token_counts.piece_counts(docs, model) == dict(counts)
    plain = [i for i in range(32_000) if not tokenizer.is_control(i) and not tokenizer.is_unknown(i)]
    total = sum(counts[i] + 0.5 for i in plain)
    pieces = {tokenizer.id_to_piece(i): math.log((counts[i] + 0.5) / total) for i in plain if not tokenizer.is_byte(i)}
    in_bytes = [i for i in plain if tokenizer.is_byte(i)]
    byte_score = math.log(sum(counts[i] + 0.5 for i in in_bytes) / len(in_bytes) / total)
    scores = token_counts.piece_scores(model, dict(counts))
    assert scores[0].keys() == pieces.keys() and math.isclose(scores[1], byte_score)
    assert all(math.isclose(scores[0][k], v) for k, v in pieces.items())
    assert math.isclose(sum(math.exp(s) for s in scores[0].values()) + len(in_bytes) * math.exp(scores[1]), 1)
    cut = {w: plain_cut(token_counts.MARK + w, *scores) for w in words}
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs).collect():
        got[r.doc_id].append((r.n_words, r.n_tokens, round(r.score, 4)))
    want = defaultdict(list)
    for doc_id, text in corpus:
        found = [cut[w] for w in split_words(text)]
        want[doc_id].append((len(found), sum(n for n, _ in found), round(sum(s for _, s in found), 4)))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


# 6 -----------------------------------------------------------------------------------------------

def fold(doc_id):
    return 9 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10


def test_language_model(spark, corpus):
    docs = {(d, t): split_words(lowered(t)) + [None] for d, t in corpus}
    train = [split_words(lowered(t)) + [None] for d, t in corpus if fold(d)]
    counts = Counter(w for words in train for w in words)
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.score_documents(frame(spark, corpus), chunk_tokens=700).collect()
    assert len(got) == len(corpus)
    by_id = defaultdict(list)
    for (d, _), words in docs.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        by_id[d].append((len(words), sum(counts[w] > 0 for w in words), round(base, 6)))
    for r in got:
        assert r.held_out == (fold(r.doc_id) == 0) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in by_id[r.doc_id]
        assert r.score < 0
    # the learned mixture beats the base on documents it has not seen
    unseen = [r for r in got if r.held_out and r.n_known > 20]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_model_probabilities_sum_to_one():
    weights = lm_scoring.learned_weights(np.array([[1, -10, -20, 5], [1, lm_scoring.NONE, -30, 5], [3, -2, -9, 7]]), 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 1:] > 0).all()


def test_key_blocks():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys)) == keys).all()
    counts = np.arange(1000) * 999
    assert (lm_scoring.unpacked_counts(lm_scoring.packed_counts(counts)) == counts).all()


# 7 -----------------------------------------------------------------------------------------------

def labelled_rows(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(count):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        kind = rng.choice(["good"] * 6 + ["toxic", "junk"])
        if kind == "toxic":
            for w in rng.sample(["vile", "nasty", "awful"], 2):
                text[rng.randrange(len(text))] = w
        if kind == "junk":
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled_rows(1, 900)
    docs = frame(spark, rows + [(5000 + i, t) for i, t in AWKWARD[:3]])
    known = spark.createDataFrame(labels[:500] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, known)
    got = {r.doc_id: r.kept for r in quality.classify(docs, model).collect()}
    want = {i: q == 1 and t == 0 for i, q, t in labels}
    wrong = [i for i in range(500, 900) if got[i] != want[i]]
    assert len(wrong) <= 8
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs, model).where("kept").count()


def test_classifier_learns_from_a_rare_language(spark):
    rows, labels = labelled_rows(4, 1500)
    docs = frame(spark, rows).unionByName(spark.createDataFrame(
        [(9000 + i, " ".join(f"RARE!! W{j * (i + 3) % 300}!!" for j in range(50)), "xx", "s0", None) for i in range(8)],
        SCHEMA))
    model = quality.train(docs, spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int"), pool=40)
    at = np.flatnonzero(model.content.words == quality._hashes[b"rare"])
    assert len(at) == 1 and model.content.weights[at[0]] < 0


def test_classifier_without_labels(spark):
    docs = frame(spark, AWKWARD)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.kept for r in quality.classify(docs, model).collect()} == {True}


# 8 -----------------------------------------------------------------------------------------------

def test_schedule():
    rng = random.Random(4)
    sizes = {f"g{i}": rng.randint(1, 100) for i in range(200)}
    placed = sharding.schedule(sizes, 7)
    loads = [0] * 7
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        assert loads[placed[name]] == min(loads)
        loads[placed[name]] += sizes[name]


@pytest.mark.parametrize("parcels", [sharding.PARCELS, 40])
def test_shards(spark, corpus, parcels):
    rows = frame(spark, corpus).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce("text", F.lit("null")).alias("group"))
    got = sharding.assign_shards(rows, 4, parcels, parcels).collect()
    shard_of = defaultdict(set)
    for r in got:
        shard_of[r.group].add(r.shard)
    assert len(got) == len(corpus) and all(len(s) == 1 for s in shard_of.values())


def test_slots(spark, corpus, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SLICE", 3)
    got = sharding.shard_documents(frame(spark, corpus), 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


# 9 -----------------------------------------------------------------------------------------------

def test_raking_meets_targets(spark):
    rng = random.Random(6)
    cells = [(s, l, t, rng.randint(1, 900)) for s in "abcd" for l in "xy" for t in "pq"]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    aims = {m: mixing.default_target(table, m) for m in mixing.MARGINALS}
    got = mixing.rake(table, aims).collect()
    for m in mixing.MARGINALS:
        for row in aims[m].collect():
            assert math.isclose(sum(r.weight for r in got if r[m] == row[m]), row.share, rel_tol=1e-8)


def test_raking_of_sparse_cells(spark):
    """One language per source but for a bridge, a null source beside an empty one: the targets hold nevertheless."""
    cells = [("a", "x", "p", 900), ("b", "x", "q", 3), ("b", "y", "p", 700), ("c", "y", "q", 2), (None, "x", "p", 50),
             ("", "y", "q", 60), ("c", "x", "p", 4)]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": 0.2, "b": 0.3, "c": 0.2, None: 0.1, "": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.55, "q": 0.45}}
    aims = {m: spark.createDataFrame(list(v.items()), f"{m} string, share double") for m, v in shares.items()}
    got = mixing.rake(table, aims).collect()
    for m, wanted in shares.items():
        for value, share in wanted.items():
            assert math.isclose(sum(r.weight for r in got if r[m] == value), share, rel_tol=1e-6)


def test_contradicting_targets_are_reported(spark):
    table = spark.createDataFrame([("a", "x", "p", 5), ("b", "y", "p", 5)], "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 1.0}}
    aims = {m: spark.createDataFrame(list(v.items()), f"{m} string, share double") for m, v in shares.items()}
    with pytest.warns(UserWarning, match="contradict"):
        assert len(mixing.rake(table, aims).collect()) == 2


def test_mixture(spark, corpus):
    docs = frame(spark, corpus)
    rated = mixing.rates(docs)
    rows = rated.collect()
    assert len(rows) == len(corpus) and all(0 <= r.rate <= 1 for r in rows)
    tokens = sum(r.n_tokens for r in rows)
    assert math.isclose(sum(r.n_tokens * r.rate for r in rows if r.n_tokens), tokens * mixing.SHARE, rel_tol=1e-6)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in rows if r.drawn)


def test_given_target(spark, corpus):
    docs = frame(spark, corpus)
    only = spark.createDataFrame([("s1", 1.0)], "source string, share double")
    assert {r.source for r in mixing.rates(docs, {"source": only}).where("drawn and n_tokens > 0").collect()} == {"s1"}


# 10 ----------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/x?a#b", "https://www.example.com/en/1",
        "https://a.www.example.com/en/", "https://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/fr", "http://net/fr/",
        "http://a.b.net#/fr/", "http://x.com", "http://x.com?/", "http://spam-farm.org/1", "http://www.cheap-pills.net/a",
        "a://b://c.com/x", "http://x.org/com/", "HTTP://X.NET/ES/", "http://ümlaut.com/ä/", "http://x.com:80/", "http://my-casino.org/"]


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3:]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = lowered(rest[:end]), rest[end:]
    path = tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r.name for r in url_filter.CONTRACT_RULES for h, _, p in [r.name.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    prepare(spark)
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(URLS)],
                                  "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    verdicts = {r.name: r.verdict for r in url_filter.CONTRACT_RULES}
    for i, url in enumerate(URLS):
        host, path, rule = brute_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdicts[rule] if rule else "block" if got[i].pattern else "allow")
    assert got[URLS.index("http://spam-farm.org/1")].verdict == "block"
    assert got[URLS.index("http://my-casino.org/")].verdict == "block"


@pytest.mark.parametrize("reverse", [False, True])
def test_urls_in_several_passes(spark, reverse):
    """The rule that decides does not depend on the pass that holds it; equal names go to block."""
    prepare(spark)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = url_filter.CONTRACT_RULES + url_filter.HOST_PATTERNS + [
        url_filter.host_rule("block", "com", "/"), url_filter.host_rule("allow", "net", "/es/")]
    whole = {tuple(r) for r in url_filter.judge_urls(pages, rules).collect()}
    parts = url_filter.judge_urls(pages, rules[::-1] if reverse else rules, per_pass=2)
    assert {tuple(r) for r in parts.collect()} == whole
    assert {r[4] for r in whole if r[3] in ("com/", "net/es/")} == {"block"}


def test_only_candidates_run():
    rules = [url_filter.host_rule("block", f"site{i}.org", "/") for i in range(50)]
    index = url_filter.RuleIndex(rules, Counter({"org": 1000}))
    assert set(index.by_token) == {f"site{i}" for i in range(50)}
    assert index.best("www.site7.org", "/x").name == "site7.org/"


# empty tables, extra columns, pipeline ------------------------------------------------------------

EMPTY_JOBS = {
    "scan": lambda d, b: decontamination.scan_documents(d, b), "cut": lambda d, b: decontamination.decontaminate(d, b),
    "repeats": lambda d, b: substring_dedup.remove_repeats(d), "copies": lambda d, b: exact_dedup.find_copies(d),
    "near": lambda d, b: near_dedup.near_dedup(d), "tokens": lambda d, b: token_counts.count_tokens(d),
    "model": lambda d, b: lm_scoring.score_documents(d), "shards": lambda d, b: sharding.shard_documents(d),
    "mix": lambda d, b: mixing.mix(d),
}


@pytest.mark.parametrize("job", EMPTY_JOBS)
def test_empty_tables(spark, job):
    items = spark.createDataFrame([], "item_id long, text string")
    assert EMPTY_JOBS[job](frame(spark, []), items).count() == 0


@pytest.mark.parametrize("job", ["cut", "near", "mix", "exact", "quality"])
def test_clashing_columns(spark, job):
    docs = frame(spark, AWKWARD).withColumns({n: F.lit(1) for n in (
        "tag", "Digest", "packed", "spans", "kept", "rate", "topic", "weight", "component_id", "shard", "__x", "points",
        "bad_id", "kept_id", "kept_tag", "text_bytes", "lang_name", "mix_source", "mix_rate")})
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    jobs = EMPTY_JOBS | {"exact": lambda d, b: exact_dedup.exact_dedup(d), "quality": lambda d, b: quality.keep_good(d, quality.Model())}
    kept = jobs[job](docs, items)
    assert kept.columns == docs.columns and kept.count() <= len(AWKWARD)
    assert kept.select([c for c in docs.columns if c not in SCHEMA]).distinct().collect() in ([], [(1,) * (len(docs.columns) - 5)])


def test_rows_without_id_are_told_apart(spark, monkeypatch):
    """Two rows without id whose texts share a 32-bit hash: one repeats a passage, the other is innocent."""
    passage = " ".join(f"p{i}" for i in range(60))
    numbers = spark.range(150_000).select(F.col("id").cast("string").alias("n"))
    one = numbers.select(F.concat(F.lit(passage + " x"), "n").alias("bad"))
    two = numbers.select(F.concat(F.lit(passage.replace("p", "c") + " y"), "n").alias("clean"))
    pair = one.join(two, F.hash("bad") == F.hash("clean")).orderBy("bad").first()
    docs = frame(spark, [(None, pair.bad), (None, pair.clean), (1, passage)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    removed = {r.kept_text for r in substring_dedup.remove_repeats(docs).collect()}
    assert pair.clean.encode() in removed and pair.bad.split()[-1].encode() in removed
    for block in (decontamination.BLOCK_BYTES, 50):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        assert [r.text for r in decontamination.decontaminate(docs, items).collect()] == [pair.clean]


def test_pipeline(spark, tmp_path):
    rows, labels = labelled_rows(2, 300)
    clean = [(1000 + i, " ".join(w)) for i, w in enumerate(sentences(9, 80, 90, 4000))]
    passage = " ".join(f"q{i}" for i in range(30))
    rows += clean + [(2000, clean[0][1]), (2001, clean[1][1] + " more"), (2002, passage)] + AWKWARD
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "sharding" and corpus_pipeline.ORACLE_SQL is None
    kept, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), kept.schema)
        assert kept.columns == docs.columns
        seen.append({r.doc_id for r in kept.collect()})
    good, single, untested, drawn = seen
    assert {i for i, _ in clean} - good == set() and 2002 not in untested and 2002 in single
    assert 2000 in good and 2000 not in single and drawn <= untested <= single <= good
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == drawn and {r.shard for r in got} <= set(range(16))
    texts = {(d, zlib.crc32((t or "").encode())) for d, t in rows}
    assert {(r.doc_id, r.text_crc32) for r in got} <= texts
