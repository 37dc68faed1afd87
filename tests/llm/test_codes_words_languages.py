"""Vector codes, spelling variants and language identification against brute force, and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import language_id, spelling, vector_codes
from docketlake.llm.common import prepare

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, place int"


# -- vector codes ---------------------------------------------------------------------------------


def vectors(spark, rows):
    """Rows of (vec_id, embedding, label), with columns whose names clash with the operator's own."""
    prepare(spark)
    return spark.createDataFrame([(*row, "x", "y", 3) for row in rows], VECTORS).repartition(3)


def coded(rows, parts=8, entries=16, rounds=6):
    """Plain Python: {row number: (code, error)}, label errors and codebooks."""
    kept = [i for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    length = len(rows[order[0]][1]) if order else 0
    width = -(-length // parts)

    def scaled(x):
        whole, rest = divmod(x, 1)
        return int(whole) * 4096 + math.floor(rest * 4096)

    whole = {i: [scaled(x) for x in rows[i][1]] + [0] * (width * parts - length) for i in kept if len(rows[i][1]) == length}
    first = [i for i in order if i in whole][:entries]
    books = [[whole[i][p * width:(p + 1) * width] for i in first] for p in range(parts)]

    def place(vector, p):
        piece = vector[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for v in whole.values():
            for p in range(parts):
                members[p, place(v, p)[1]].append(v[p * width:(p + 1) * width])
        books = [[[sum(c) // len(members[p, e]) for c in zip(*members[p, e])] if members[p, e] else entry
                  for e, entry in enumerate(part)] for p, part in enumerate(books)]
    found = {i: ("", None) for i in kept}
    for i, v in whole.items():
        best = [place(v, p) for p in range(parts)]
        found[i] = "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)
    return found, books


def compare(spark, rows):
    got, books = vector_codes.compress(vectors(spark, rows))
    found, want = coded(rows)
    assert books.entries == want
    fits = 2**63 - 1
    sums = defaultdict(lambda: None)
    for i, (_, error) in found.items():
        error = None if error is None or error > fits else error
        if error is not None:
            sums[rows[i][2]] = (sums[rows[i][2]] or 0) + error
    expected = Counter()
    for i, (code, error) in found.items():
        total = sums[rows[i][2]]
        expected[rows[i][0], rows[i][2], code or None, error if error is not None and error <= fits else None,
                 total if total is None or total <= fits else None] += 1
    assert expected == Counter(
        (r["vec_id"], r["label"], bytes(r["code"]).hex() if r["code"] is not None else None, r["error"], r["label_error"])
        for r in got.collect())
    numbers = ",".join(str(x) for part in want for entry in part for x in entry)
    assert books.digest() == hashlib.sha256(numbers.encode()).hexdigest()
    return books


def test_codes_against_plain_integers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(100 + i, rows[3][1], 1) for i in range(20)]  # copies
    rows += [(7, [0.5] * 16, 2), (None, [0.25] * 16, None), (None, [0.25] * 16, None)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [NAN] * 16, 1), (-2, [INF] + [0.0] * 15, 2), (-1, [None] + [0.0] * 15, 2)]
    rows = [r for r in rows if r[0] != -4] + [(900, [], 1), (901, [1.0] * 15, 1)]  # other lengths: no code
    compare(spark, rows)


@pytest.mark.parametrize("size", [2.0**16, 2.0**40, 1e300])
def test_large_components_are_exact(spark, size):
    rng = random.Random(2)
    compare(spark, [(i, [rng.uniform(-size, size) for _ in range(8)], 1) for i in range(25)] + [(50, [0.0001] * 8, 1)])


def test_ties_few_vectors_and_odd_lengths(spark):
    compare(spark, [(i, [float(i % 2)] * 3, None) for i in range(5)])  # three components in eight parts
    compare(spark, [(1, [], 1), (2, [], 1)])
    books = compare(spark, [(3, [0.5, -0.25] * 8, 1)])
    assert books.decode(bytes(8)) == [0.5, -0.25] * 8


def test_no_vectors(spark):
    got, books = vector_codes.compress(vectors(spark, []))
    assert got.collect() == [] and books.entries == [[]] * 8
    got, _ = vector_codes.compress(vectors(spark, [(1, None, 1), (2, [NAN] * 8, 1)]))
    assert got.collect() == []


def test_dot_products_from_limbs():
    rng = np.random.default_rng(3)
    for bits in (5, 20, 27):
        a, b = (rng.integers(-2**bits, 2**bits, (7, 8)) for _ in range(2))
        a[0], b[0] = 2**bits - 1, -2**bits
        assert (vector_codes.dot_products(a, b) == a.astype(object) @ b.T.astype(object)).all()
    wide = np.full((1, 4096), 2**22 - 1)
    assert vector_codes.dot_products(wide, wide)[0, 0] == 4096 * (2**22 - 1) ** 2


# -- spelling variants ----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(rows):
    """Plain Python version of spelling_groups."""
    counts = Counter()
    for doc_id, text in rows:
        runs, run = Counter(), ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                runs[run] += 1
                run = ""
        for run, n in runs.items():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += n
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def texts(spark, rows):
    prepare(spark)
    return spark.createDataFrame(
        [(i, t, "en", "k", 1, 2) for i, t in rows], "doc_id long, text string, lang string, key string, n int, word int").repartition(3)


def misspelt(seed, words, copies):
    rng = random.Random(seed)
    letters = "abcé×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(words)]
    out = []
    for word in base:
        variants = [word, word + rng.choice(letters), word[1:], word[:2] + rng.choice(letters) + word[3:], word[::-1]]
        for v in variants:
            out += [v.upper() if rng.random() < 0.2 and v.isascii() else v] * rng.choice([1, 3, 4, 6, 9, 20])
    rng.shuffle(out)
    return [(i, " ".join(out[i::copies])) for i in range(copies)]


AWKWARD = [(1, None), (2, ""), (3, " 1 2\n"), (None, "Wörter wörter wörter WÖRTER"), (None, None), (4, "漢字abcde漢abcde字abcde"),
           (5, "z" * 70_000 + " " + "z" * 70_000 + " " + "z" * 69_999), (5, "z" * 70_000 + " " + "z" * 69_999),
           (5, "z" * 70_000 + " " + "z" * 69_999), (6, "Ááááá ááááá ÿÿÿÿÿ"), (6, "Ááááá ááááá ÿÿÿÿÿ"), (6, "Ááááá ááááá ÿÿÿÿÿ")]


@pytest.mark.parametrize("cell, box", [(8192, 16), (40, 16), (3, 2)])
def test_spelling_groups_by_brute_force(spark, monkeypatch, cell, box):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "BOX", box)
    rows = misspelt(cell, 150, 6) + AWKWARD
    got = [tuple(r) for r in spelling.spelling_groups(texts(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(rows)
    assert any(form and root != form for _, form, root, *_ in got)  # a chain of forms


def test_no_words(spark):
    assert spelling.spelling_groups(texts(spark, [])).collect() == []
    assert spelling.spelling_groups(texts(spark, [(1, None), (2, "short words here")])).collect() == []


def test_cells_reach_all_near_words():
    rng = random.Random(4)
    words = list({bytes(rng.choice(b"abcde\xe9") for _ in range(6)) for _ in range(800)})
    points = spelling.points_of(spelling.letters_of(words, 6))
    cells = spelling.Cells(points[:300], 12)
    own = cells.own(points)
    assert len(set(own.tolist())) > 6
    reach = set(zip(*(c.tolist() for c in cells.reached(points, 1))))
    assert all((i, own[i]) in reach for i in range(len(words)))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if one_edit(a, b):
                assert (i, own[j]) in reach


def test_cells_do_not_grow_with_anagrams():
    word = spelling.letters_of([b"abcdef"] * 50, 6)
    assert spelling.Cells(spelling.points_of(word), 9).count == 1
    found = list(spelling.box_search(spelling.points_of(word), spelling.points_of(word[:2]), 1))
    assert sum(len(a) for a, _ in found) == 100


# -- language identification ----------------------------------------------------------------------


def sentences(count, seed=0, start=0):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["sch", "ön", "ücht", "ver"], "cc": ["tion", "que", "é", "los"]}
    rows = []
    for i in range(start, start + count):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.choice([3, 20, 200])))
        rows.append((i, text, lang))
    return rows


def labelled(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, score double, at int").repartition(3)


def test_languages_of_held_out_documents(spark):
    rows = sentences(300)
    got = {r["doc_id"]: r for r in language_id.predict_languages(labelled(spark, rows)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # held-out labels, sources and ids change nothing
    changed = [(i, t, "bb" if got[i]["held_out"] else lang) for i, t, lang in rows]
    again = {r["doc_id"]: r for r in language_id.predict_languages(labelled(spark, changed)).collect()}
    assert all(again[i]["lang_pred"] == got[i]["lang_pred"] for i, *_ in rows)


def test_awkward_texts(spark):
    rows = sentences(90) + [
        (1000, None, "aa"), (1001, "", "bb"), (1002, " 12 !? __ 3", "aa"), (None, "karomi taka", None), (None, None, None),
        (1003, "ü", "zz"), (1004, "verschön " * 30_000, "bb"), (1005, "x\0y", ""), (1005, "x\0y", "")]
    got = language_id.predict_languages(labelled(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[1004]["lang_pred"] == "bb"
    assert {r["lang_pred"] for r in got} <= {"aa", "bb", "cc", "zz", "", "und"}
    assert not [r["held_out"] for r in got if r["doc_id"] is None][0]


def test_nothing_to_learn_from(spark):
    assert language_id.predict_languages(labelled(spark, [])).collect() == []
    got = language_id.predict_languages(labelled(spark, [(1, "some text", None), (3, "more", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_draw_is_bounded_and_copies_count_once(spark):
    rows = sentences(200) + [(5000 + i, "ta" * 500, "aa") for i in range(400)]
    drawn = language_id.draw(labelled(spark, rows), 90).groupBy("lang").count().collect()
    assert len(drawn) == 3 and all(r["count"] <= 30 for r in drawn)
    every = language_id.draw(labelled(spark, rows), 90_000).where(F.hex("window").startswith("746174617461"))
    assert every.count() <= language_id.OF_TEXT + 40  # not four for each of the 400 copies


def test_windows_cover_a_text():
    for n in (1, 191, 192, 193, 384, 1000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        windows = language_id.cut(text)
        assert windows.shape == (max(1, -(-n // 192)), 192)
        assert b"".join(w.tobytes() for w in windows[:-1]) == text[:192 * (len(windows) - 1)]
        assert windows[-1].tobytes().rstrip(b"\0").endswith(text[-min(n, 192):])


def test_network_by_loops_and_differences():
    rng = np.random.default_rng(1)
    net = language_id.ByteNet.fresh(["a", "b", "c"], rng)
    windows = rng.integers(0, 256, (5, language_id.SIZE), dtype=np.uint8)
    labels = np.array([0, 1, 2, 1, 0])
    hidden = []
    for window in windows:
        row = []
        for width in language_id.WIDTHS:
            vectors = net.weights["bytes"][window]
            runs = [vectors[p:p + width].ravel() for p in range(language_id.SIZE - width + 1)]
            row += list(np.maximum(np.max([r @ net.weights[f"filter{width}"] for r in runs], axis=0) + net.weights[f"bias{width}"], 0))
        hidden.append(row)
    want = language_id.softmax(np.array(hidden) @ net.weights["out"] + net.weights["shift"])
    assert np.allclose(net.probabilities(windows), want, atol=1e-5)
    assert np.allclose(net.pooled(windows)[0], hidden, atol=1e-4)

    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        return -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()

    for name, slope in net.gradients(windows, labels).items():
        flat = net.weights[name].reshape(-1)
        for at in (rng.choice(len(flat), 4) if name != "bytes" else windows[0, :4].astype(int) * language_id.DEPTH):
            old, step = flat[at], 1e-6
            flat[at] = old + step
            above = loss()
            flat[at] = old - step
            below = loss()
            flat[at] = old
            assert abs((above - below) / (2 * step) - slope.reshape(-1)[at]) < 1e-4
