"""Sliced ranks and totals equal plain windows, whatever the skew and the borders."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake import session
from docketlake.operators import ordered
from docketlake.operators import naming as names


@pytest.fixture
def sliced(monkeypatch):
    """Make every group too large for a task."""
    monkeypatch.setattr(ordered, "SLICES", 40)


def hot_rows(n=600):
    rnd = random.Random(5)
    return [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 30)}", f"p{rnd.randint(0, 10**6):07d}-{i}", rnd.randint(-3, 9))
            for i in range(n)]


def expected(rows):
    out, seen = {}, {}
    for key, path, value in sorted(rows, key=lambda r: (r[0], r[1])):
        rank, total = seen.get(key, (0, 0))
        seen[key] = rank + 1, total + value
        out[path] = seen[key]
    return out


def test_rank_and_total_of_hot_group(spark, sliced):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, p string, v int").repartition(5)
    assert ordered.in_slices(df, ["k"], ["p"]).where("k = 'hot'").select("_slice").distinct().count() > 10
    ranked = ordered.rank_in_groups(df, ["k"], ["p"], "rank")
    both = ordered.running_total(ranked, ["k"], ["p"], F.col("v"), "total")
    assert {r["p"]: (r["rank"], r["total"]) for r in both.collect()} == expected(rows)


def test_without_keys(spark, sliced):
    df = spark.range(1000).repartition(7)
    ranked = ordered.rank_in_groups(df, [], ["id"], "rank")
    assert ranked.where("rank <> id + 1").count() == 0 and ranked.count() == 1000


@pytest.mark.parametrize("slices", [1, 2, 7, 300])
def test_any_number_of_slices_gives_the_same(spark, monkeypatch, slices):
    monkeypatch.setattr(ordered, "SLICES", slices)
    df = spark.createDataFrame(hot_rows(200), "k string, p string, v int")
    got = ordered.running_total(df, ["k"], ["p"], F.col("v"), "total").collect()
    assert {r["p"]: r["total"] for r in got} == {p: t for p, (_, t) in expected(hot_rows(200)).items()}


def test_ties_and_null_times_are_split_by_the_last_column(spark, sliced):
    """One key and three times, one of them null: slices follow the ids."""
    rows = [("a" if i % 50 else None, None if i % 3 == 0 else i % 3, i) for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, id int")
    parts = ordered.in_slices(df, ["k"], ["at", "id"])
    assert parts.where("k = 'a' and at is null").select("_slice").distinct().count() > 5
    got = {r["id"]: r["rank"] for r in ordered.rank_in_groups(df, ["k"], ["at", "id"], "rank").collect()}
    want, seen = {}, {}
    for k, at, i in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0, r[2])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_previous_row_across_slices(spark, sliced):
    rows = [(random.Random(i).choice("ab"), i // 3, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = ordered.previous_in_groups(ordered.in_slices(df, ["k"], ["at", "id"]), ["k"], ["at", "id"], "at", "before")
    want, last = {}, {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], last[k] = last.get(k), at
    assert {r["id"]: r["before"] for r in got.collect()} == want


def test_rows_of_one_path_are_all_kept(spark):
    df = spark.createDataFrame([("p", "x/a.txt")] * 3 + [(None, "x/a.txt")], "path string, target_path string")
    got = sorted(r["resolved_path"] for r in names.resolve_conflicts(df).collect())
    assert got == ["x/a.txt", "x/a_conflict01.txt", "x/a_conflict02.txt", "x/a_conflict03.txt"]


def test_staged_folders_are_released(spark):
    session.staged(spark.range(5))
    assert session.release(spark) >= 1 and session.release(spark) == 0


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    top = ordered.first_rows(df, ["k"], [F.col("id").desc()], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["id"] for r in top.collect()) == list(range(990, 1000))


def split_name(path):
    stem, dot, ext = path.rpartition(".")
    return (stem, dot + ext) if dot and stem.strip(".") else (path, "")


def brute_conflicts(asked, existing, suffix):
    """First come keeps the name, later ones the lowest number nobody holds or asks for."""
    reserved = set(existing) | {t for _, t in asked}
    given, used = {}, set(existing)
    for path, target in sorted(asked):
        if target not in used:
            given[path] = target
            used.add(target)
            continue
        stem, ext = split_name(target)
        number = 1
        while f"{stem}{suffix}{number:02d}{ext}" in reserved | used:
            number += 1
        given[path] = f"{stem}{suffix}{number:02d}{ext}"
        used.add(given[path])
    return given


@pytest.mark.parametrize("suffix", ["_conflict", "_"])
@pytest.mark.parametrize("force_slices", [False, True])
def test_conflicts_against_brute_force(spark, monkeypatch, suffix, force_slices):
    if force_slices:
        monkeypatch.setattr(ordered, "SLICES", 25)
    rnd = random.Random(11)
    targets = ["d/a.pdf", "d/a.pdf", "d/a.pdf", "d/b.pdf", f"d/a{suffix}01.pdf", f"d/a{suffix}03.pdf", "d/noext",
               f"d/a{suffix}001.pdf", f"d/b{suffix}02.pdf"]
    asked = [(f"p{i:03d}", rnd.choice(targets)) for i in range(120)]
    existing = ["d/a.pdf", f"d/b{suffix}01.pdf", f"d/noext{suffix}07", f"d/a{suffix}10.pdf", "d/zzz.pdf"]
    df = spark.createDataFrame(asked, "path string, target_path string")
    held = spark.createDataFrame([(e,) for e in existing], "target_path string")
    solve = names.resolve_conflicts if suffix == "_conflict" else names.unique_names
    got = {r["path"]: r["resolved_path"] for r in solve(df, existing=held).collect()}
    assert got == brute_conflicts(asked, existing, suffix)
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(existing)


def test_existing_names_move_on(spark):
    """The next free number after names that exist already."""
    df = spark.createDataFrame([("p", "x/file.txt")], "path string, target_path string")
    held = spark.createDataFrame([("x/file.txt",), ("x/file_conflict01.txt",)], "target_path string")
    assert names.resolve_conflicts(df, existing=held).first()["resolved_path"] == "x/file_conflict02.txt"
    held = spark.createDataFrame([("x/file.txt",), ("x/file_01.txt",)], "target_path string")
    assert names.unique_names(df, existing=held).first()["resolved_path"] == "x/file_02.txt"


def test_null_keys_keep_their_rows(spark, sliced):
    rows = [(None if i % 3 else "a", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, p int")
    got = {r["p"]: r["rank"] for r in ordered.rank_in_groups(df, ["k"], ["p"], "rank").collect()}
    want = {p: sum(1 for k2, p2 in rows if k2 == k and p2 <= p) for k, p in rows}
    assert got == want
