"""Operators against brute force on small, awkward inputs."""

import random
import time
from collections import Counter, deque
from datetime import date, datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketlake.operators import corpus, corrections, deadlines, documents, fuzzy, jobs, ordered, pages, rates, vendors


# --- vendors ---------------------------------------------------------------------------


def brute_match(name, masters, normal, threshold=80):
    """The earliest of the masters with the highest score, if that reaches the threshold."""
    scored = [(SequenceMatcher(None, normal[name], normal[m]).ratio() * 100, -at) for at, m in enumerate(masters)]
    score, place = max(scored, default=(0.0, 0)) if name else (0.0, 0)
    return (masters[-place], score) if score and score >= threshold else (name, 0.0)


@pytest.mark.parametrize("step", [3, 5, 50])
def test_fuzzy_match_equals_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(fuzzy, "STEP", step)
    monkeypatch.setattr(fuzzy, "RANKED", 20 if step == 50 else 20_000)
    rnd = random.Random(2)
    words = ["acme", "globex", "initech", "umbrella", "stark", "wayne", "oscorp", "hooli", "ab", "b"]

    def spoil(text):
        chars = list(text)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(chars) + 1)
            if rnd.random() < 0.5 and chars:
                del chars[min(i, len(chars) - 1)]
            else:
                chars.insert(i, rnd.choice("aeiou x"))
        return "".join(chars)

    masters = [f"{rnd.choice(words)} {rnd.choice(words)} {rnd.choice(['Inc', 'LLC', 'Ltd.', 'systems'])}" for _ in range(60)]
    names = sorted({spoil(rnd.choice(masters)) for _ in range(150)} | {"ab", "a", "LLC", "zzz", ""})
    master = spark.createDataFrame(list(enumerate(masters)), "pos long, master_vendor string")
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "vendor string")
    got = {r["vendor"]: (r["matched_vendor"], r["match_score"]) for r in vendors.match_vendors(df, master).collect()}
    everything = spark.createDataFrame([(n,) for n in set(names) | set(masters)], "v string")
    normal = {r["v"]: r["n"] for r in everything.select("v", vendors.normalize_vendor(F.col("v")).alias("n")).collect()}
    want = {n: brute_match(n, masters, normal) for n in names}
    want[None] = (None, 0.0)
    assert {k: (v[0], pytest.approx(v[1])) for k, v in want.items()} == got
    assert sum(1 for n in names if 0 < want[n][1] < 100) > 30


@pytest.mark.parametrize("listed, group", [(1500, 4), (40, 4), (40, 2), (0, 4)])
def test_names_that_are_nearly_alike(spark, monkeypatch, listed, group):
    """Numbers in one phrase: near masters are found, and those that are far off are not met where parts can be listed."""
    monkeypatch.setattr(fuzzy, "LISTED", listed)
    monkeypatch.setattr(fuzzy, "TOGETHER", group)
    rnd = random.Random(4)
    masters = [f"customer {rnd.randrange(30000):09d}" for _ in range(150)]
    names = [f"ucstomer {m[9:]} llu" for m in masters[:12]] + [m + "ßñ" for m in masters[:12]] + [
        f"customer {rnd.randrange(30000):09d}" for _ in range(12)] + ["customer", "é"]
    master = spark.createDataFrame(list(enumerate(masters)), "pos long, master_vendor string")
    df = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "vendor string")
    got = {r["vendor"]: (r["matched_vendor"], r["match_score"]) for r in vendors.match_vendors(df, master).collect()}
    normal = {n: n for n in names + masters}
    assert got == {n: (v[0], pytest.approx(v[1])) for n in names for v in [brute_match(n, masters, normal)]}
    if listed == 1500:
        edited = spark.createDataFrame([(m + "ßñ",) for m in set(masters)], "norm string")
        targets = spark.createDataFrame([(m, i) for i, m in enumerate(set(masters))], "norm string, pos long")
        assert fuzzy.candidates(edited, targets, 90.0, [20], [18]).count() == len(set(masters))


def lcs(one, two):
    row = [0] * (len(two) + 1)
    for a in one:
        above, row = row, [0]
        for j, b in enumerate(two):
            row.append(above[j] + 1 if a == b else max(above[j + 1], row[-1]))
    return row[-1]


@pytest.mark.parametrize("tree, walkers", [(20_000, 2000), (50, 2)])
def test_crowded_names_walk_trees(spark, monkeypatch, tree, walkers):
    """Names alike in all but a few digits share rare elements with every master; only masters with enough in common are met."""
    monkeypatch.setattr(fuzzy, "TREE", tree)
    monkeypatch.setattr(fuzzy, "WALKERS", walkers)
    monkeypatch.setattr(fuzzy, "CROWD", 0)
    masters = [f"customer {i * 7:09d}" for i in range(700)] + ["customer of none"]
    names = [f"ucstomer {i * 70:09d} llu" for i in range(12)] + ["ucstomer 000000003 llu", "an entirely other name"]
    targets = spark.createDataFrame([(m, i) for i, m in enumerate(masters)], "norm string, pos long")
    asked = spark.createDataFrame([(n,) for n in names], "norm string")
    for level in (85.0, 80.0):
        met = {tuple(r) for r in fuzzy.by_elements(asked, targets, level, [(22, 18)]).collect()}
        assert met == {(n, i) for n in names for i, m in enumerate(masters)
                       if len(m) == 18 and lcs(n, m) >= fuzzy.needed(level, 22, 18)}


def test_trees_are_walked_as_far_as_enough_can_be_shared():
    rnd = random.Random(6)
    for _ in range(200):
        letters, size = rnd.choice(["ab", "abc ", "abcdéfgh"]), rnd.randint(1, 8)
        texts = sorted({"".join(rnd.choices(letters, k=size)) for _ in range(30)})
        root, asked = fuzzy.grown(zip(texts, texts)), "".join(rnd.choices(letters, k=rnd.randint(1, 9)))
        for need in range(1, min(size, len(asked)) + 1):
            assert sorted(fuzzy.reached(root, asked, size, need)) == [t for t in texts if lcs(t, asked) >= need]


def test_matching_broadcasts_no_names(spark):
    """Names compress so well that they look small; only frames of a few rows may be broadcast."""
    masters = spark.createDataFrame([(f"customer {i:09d}", i) for i in range(20)], "norm string, pos long")
    names = spark.createDataFrame([("customer 000000005ßñ",)], "norm string")
    found = fuzzy.candidates(names, masters, 90.0, [20], [18])
    done = vendors.match_vendors(names, masters.withColumnRenamed("norm", "master_vendor"), "norm")
    for df in (found, done):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_master(spark):
    master = spark.createDataFrame([], "pos long, master_vendor string")
    df = spark.createDataFrame([("Acme",)], "vendor string")
    assert tuple(vendors.match_vendors(df, master).first()) == ("Acme", "Acme", 0.0)


# --- rates -------------------------------------------------------------------------------


def brute_limiter(rows, limits, seconds):
    state, refused = {}, set()
    for request_id, bucket, client, at in sorted(rows, key=lambda r: (r[3], r[0])):
        limit = limits.get(bucket, 0)
        if limit <= 0:
            continue
        kept = state.setdefault((bucket, client), deque())
        while kept and (at - kept[0]).total_seconds() >= seconds:
            kept.popleft()
        if len(kept) >= limit:
            refused.add(request_id)
        else:
            kept.append(at)
    return refused


def request_rows():
    rnd = random.Random(4)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        client = "hot" if rnd.random() < 0.5 else f"c{rnd.randint(0, 4)}"
        at = base + timedelta(seconds=rnd.choice([0, 30, 60, 600]) * rnd.randint(0, 6) + rnd.randint(0, 59), microseconds=rnd.choice([0, 1]))
        rows.append((i, rnd.choice(["auth", "upload", "free"]), client, at))
    return rows


@pytest.mark.parametrize("force_slices", [False, True])
def test_sliding_limiter(spark, monkeypatch, force_slices):
    if force_slices:
        monkeypatch.setattr(ordered, "SLICES", 25)
    rows = request_rows()
    limits = {"auth": 3, "upload": 5}
    df = spark.createDataFrame(rows, "request_id long, bucket string, client string, seen_at timestamp")
    got = {r["request_id"] for r in rates.sliding_rate_violations(df, limits).collect()}
    want = brute_limiter(rows, limits, 60)
    assert got == want and 50 < len(want) < 850


@pytest.mark.parametrize("rounds", [1, 2, 6])
@pytest.mark.parametrize("lull", [0, 50])
def test_limiter_of_one_hot_client(spark, monkeypatch, rounds, lull):
    """All requests are of one client and one run: steady pressure, and pressure that lets up now and then."""
    monkeypatch.setattr(ordered, "SLICES", 12)
    monkeypatch.setattr(rates, "ROUNDS", rounds)
    rnd, base, at, rows = random.Random(7), datetime(2024, 1, 1), 0.0, []
    for i in range(700):
        at += lull if lull and i % 60 == 0 else rnd.choice([0, 1, 2, 7])
        rows.append((i, "auth", None, base + timedelta(seconds=at)))
    df = spark.createDataFrame(rows, "request_id long, bucket string, client string, seen_at timestamp").repartition(5)
    got = rates.sliding_rate_violations(df, {"auth": 6}).collect()
    assert {r["request_id"] for r in got} == brute_limiter([(*r[:2], "x", r[3]) for r in rows], {"auth": 6}, 60)
    assert len(got) == len({r["request_id"] for r in got})


def test_refused_requests_do_not_count(spark):
    """A plain trailing count would refuse the last request as well."""
    base = datetime(2024, 1, 1)
    seconds = [0, 1, 30, 40, 50, 60.5]
    df = spark.createDataFrame(
        [(i, "auth", "c", base + timedelta(seconds=s)) for i, s in enumerate(seconds)],
        "request_id long, bucket string, client string, seen_at timestamp",
    )
    got = sorted(r["request_id"] for r in rates.sliding_rate_violations(df, {"auth": 2}).collect())
    assert got == [2, 3, 4]


def test_rolling_counts(spark):
    rows = request_rows()
    df = spark.createDataFrame(rows, "request_id long, bucket string, client string, seen_at timestamp")
    got = {(r["client"], r["seen_at"]): r["trailing_count"] for r in rates.rolling_event_counts(df).collect()}
    for client, at in got:
        want = sum(1 for _, _, c, t in rows if c == client and timedelta(0) <= at - t < timedelta(seconds=60))
        assert got[client, at] == want


def test_rolling_counts_of_a_crowded_window(spark):
    """All events lie in one window: adding up the window for every event would take minutes."""
    n = 150_000
    df = spark.range(n).select(F.lit("c").alias("client"), F.timestamp_micros(F.col("id") * 100).alias("seen_at"))
    start = time.perf_counter()
    wrong = rates.rolling_event_counts(df).where("n <> 1 or trailing_count <> unix_micros(seen_at) div 100 + 1")
    assert wrong.count() == 0
    assert time.perf_counter() - start < 30


# --- jobs ----------------------------------------------------------------------------------


def test_lineage_of_trees_chains_and_cycles(spark):
    parent = {1: None, 2: 1, 3: 2, 4: 2, 5: 1, 6: 999, 7: 8, 8: 7, 9: 9}
    parent.update({100 + i: (100 + i - 1 if i else None) for i in range(40)})
    parent.update({1000 + i: 3 for i in range(50)})
    df = spark.createDataFrame(list(parent.items()), "job_id long, parent_job_id long")
    got = {r["job_id"]: (r["root_job_id"], r["depth"]) for r in jobs.job_lineage(df).collect()}

    def walk(job):
        depth, seen = 0, set()
        while parent[job] in parent:
            if job in seen:
                return None, None
            seen.add(job)
            job, depth = parent[job], depth + 1
        return job, depth

    assert got == {j: walk(j) for j in parent}


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 100, 777])
def test_nearest_rank(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.randint(0, 10), rnd.randint(0, 900_000)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "ms long")
    got = jobs.nearest_rank(df, "ms", 0.95).collect()
    ordered_values = sorted(values)
    want = ordered_values[min(n - 1, max(0, int(n * 0.95 + 0.999) - 1))] if n else 0
    assert [r["ms"] for r in got] == [want]


@pytest.mark.parametrize("force_slices", [False, True])
def test_max_concurrency(spark, monkeypatch, force_slices):
    if force_slices:
        monkeypatch.setattr(ordered, "SLICES", 25)
    rnd = random.Random(8)
    base = datetime(2024, 1, 1)
    rows = []
    for _ in range(300):
        start = rnd.randint(0, 500)
        rows.append((base + timedelta(seconds=start), base + timedelta(seconds=start + rnd.randint(0, 40))))
    rows.append((base, None))
    df = spark.createDataFrame(rows, "started_at timestamp, finished_at timestamp")
    want = max(sum(1 for s, e in rows if e and s <= base + timedelta(seconds=t) < e) for t in range(600))
    assert jobs.max_concurrency(df).first()[0] == want
    assert jobs.max_concurrency(df.limit(0)).first()[0] == 0


def test_lease_periods_split_at_the_lease(spark):
    base = datetime(2024, 1, 1)
    beats = [0, 15, 105, 196, 286, 400]
    df = spark.createDataFrame([(1, base + timedelta(seconds=s)) for s in beats], "job_id long, heartbeat_at timestamp")
    got = sorted((r["first_heartbeat"], r["lease_expired_at"], r["heartbeats"]) for r in jobs.lease_periods(df).collect())
    assert [(int((a - base).total_seconds()), int((b - base).total_seconds()), n) for a, b, n in got] == [
        (0, 195, 3), (196, 376, 2), (400, 490, 1),
    ]


def test_stale_lease_boundary(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(1, now - timedelta(seconds=90), 1), (2, now - timedelta(seconds=91), 1), (3, None, 3), (4, now - timedelta(hours=1), 4)]
    df = spark.createDataFrame(
        [(j, j, None, "processing", a, 3, h) for j, h, a in rows] + [(5, 5, None, "queued", 1, 3, None)],
        "job_id long, document_id long, tenant_id long, status string, attempts int, max_attempts int, heartbeat_at timestamp",
    )
    attempts = spark.createDataFrame(
        [(2, 1, "processing", now - timedelta(seconds=100)), (3, 3, "failed", now)],
        "job_id long, attempt_number int, status string, started_at timestamp",
    )
    got = {r["job_id"]: r for r in jobs.stale_leases(df, attempts, now).collect()}
    assert {j: r["outcome"] for j, r in got.items()} == {2: "requeued", 3: "failed", 4: "failed"}
    assert got[2]["attempt_status"] == "abandoned" and got[2]["duration_ms"] == 100_000 and got[2]["attempt_retryable"]
    assert got[3]["attempt_status"] is None


# --- pages -----------------------------------------------------------------------------------


def brute_widen(texts):
    import re

    from docketlake import fixed

    size = min(7, len(texts))
    stop = min(2, size)
    while True:
        text = "".join(t + "\n" for t in texts[:stop] if t).strip()
        region = bool(text) and any(re.search(p, text, re.I) for p in fixed.REGION_PATTERNS)
        if region or len(text) >= 200 or stop >= size:
            return text, region, stop
        stop += 1


def test_widening(spark):
    rnd = random.Random(6)
    parts = ["", " ", "x" * 30, "y" * 120, "amendment", "word ", "\n"]
    docs = {d: ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(1, 10))] for d in range(80)}
    rows = [(d, n, t) for d, ts in docs.items() for n, t in enumerate(ts, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["region_found"], r["pages_read"]) for r in pages.widen_front_pages(df).collect()}
    assert got == {d: brute_widen(ts) for d, ts in docs.items()}
    tails = {r["doc_id"]: r["tail_text"] for r in pages.tail_pages_text(df).collect()}
    assert tails == {d: "".join(t + "\n" for t in ts[-5:]) for d, ts in docs.items()}


def test_document_text_and_paragraphs(spark):
    rows = [(1, 1, "short"), (1, 2, "long enough page"), (1, 3, "another long page"), (1, 6, "never read at all"), (2, 1, "tiny"), (3, 1, "z" * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    got = {r["doc_id"]: (r["text"], r["needs_ocr"]) for r in pages.document_text(df).collect()}
    assert got == {1: ("long enough page\nanother long page", True), 2: ("", True), 3: ("z" * 5000, False)}
    lines = spark.createDataFrame([(1, n, "ab") for n in range(1, 6001)], "doc_id long, paragraph_no int, text string")
    assert pages.paragraphs_to_text(lines).first()["text"] == ("ab\n" * 6000)[:5000]


# --- documents ----------------------------------------------------------------------------------


def test_deadline_window(spark):
    today = date(2024, 1, 1)
    days = {"expiration_date": -5, "renewal_date": 90, "review_date": 91, "termination_date": 30}
    df = spark.createDataFrame(
        [(1, 1, "v", *[today + timedelta(days=n) for n in days.values()])],
        "doc_id long, tenant_id long, vendor string, " + ", ".join(f"{k} date" for k in days),
    )
    got = [(r["kind"], r["days_remaining"], r["urgency"]) for r in deadlines.deadlines(df, today, 90).collect()]
    assert got == [("expiration", -5, "overdue"), ("termination", 30, "soon"), ("renewal", 90, "later")]
    assert deadlines.deadlines(df, today, 0).count() == 1  # at least one day


def test_expiry_edges(spark):
    now = datetime(2024, 1, 1)
    dates = ["2024-01-01", "2023-12-31", "2024-03-31", "2024-04-01", "not-a-date", None, "2025-01-07T12:00:00", "2025-01-08"]
    df = spark.createDataFrame([(f"t{i}", d, "X") for i, d in enumerate(dates)], "tracking_id string, expiration_date string, retention_category string")
    status = {r["tracking_id"]: (r["expiration_status"], r["days_until_expiration"]) for r in deadlines.expiry_report(df, now).collect()}
    assert status == {
        "t0": ("expiring_soon", 0), "t1": ("expired", -1), "t2": ("expiring_soon", 90), "t3": ("active", 91),
        "t4": ("no_expiration", None), "t5": ("no_expiration", None), "t6": ("active", 372), "t7": ("active", 373),
    }
    kept = [r["tracking_id"] for r in deadlines.expiring_documents(df, now, 12).collect()]
    assert kept == ["t0", "t2", "t3"]  # 372 days ahead ends at midnight
    assert [r["tracking_id"] for r in deadlines.expiring_next_year(df, now).collect()] == ["t0", "t2", "t3"]
    assert deadlines.by_retention_category(df, "x").count() == len(dates)
    assert deadlines.by_retention_category(df, "other").count() == 0


def test_unknown_status_is_ignored_and_wildcards_work(spark):
    df = spark.createDataFrame(
        [(1, "pending", "MSA", "Acme", "a.pdf", "some text"), (2, "failed", "NDA", None, "b.pdf", None)],
        "doc_id long, status string, document_type string, vendor string, original_name string, text string",
    )
    assert documents.filter_documents(df, status="nonsense").count() == 2
    assert documents.filter_documents(df, status="failed").count() == 1
    assert [r["doc_id"] for r in documents.search_documents(df, "SOME%t_xt").collect()] == [1]
    assert [r["doc_id"] for r in documents.search_documents(df, "B.P").collect()] == [2]


def test_filters_reach_the_scan(spark, tmp_path):
    from docketlake.sources.tables import load_tables, schema_of

    for name in ("tenants", "users", "documents", "document_relationships", "audit_events", "document_jobs", "document_job_attempts"):
        spark.createDataFrame([], schema_of(name)).write.parquet(f"{tmp_path}/{name}")
    docs = load_tables(spark, str(tmp_path))["documents"]
    plan = documents.review_queue(documents.tenant_scope(docs, 3))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(review_status,needs_review)" in plan and "tenant_id" in plan.split("PushedFilters")[1]
    stats = documents.document_stats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<status:string,review_status:string,document_type:string,execution_status:string>" in stats
    due = deadlines.deadlines(docs, date(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in due.split("PushedFilters")[1].split("\n")[0]


# --- corrections -----------------------------------------------------------------------------------


def test_corrections(spark):
    schema = (
        "doc_id long, tenant_id long, document_type string, execution_status string, retention_category string, vendor string, "
        "review_notes string, effective_date date, expiration_date date, renewal_date date, review_date date, "
        "termination_date date, review_status string, reviewed_by_id long, reviewed_at timestamp"
    )
    start = date(2024, 5, 1)
    docs = spark.createDataFrame(
        [(i, 1, "MSA", "final", None, "Acme", None, start, None, None, None, None, "needs_review", None, None) for i in range(1, 8)], schema
    )
    patches = spark.createDataFrame([
        (1, 1, 9, {"document_type": "nda", "vendor": " New ", "mark_reviewed": "true"}),
        (2, 1, 9, {"expiration_date": "2024-04-30"}), (3, 1, 9, {"document_type": "bad"}),
        (4, 1, 9, {"review_notes": "n" * 4001}), (5, 1, 9, {"effective_date": "05/01/2024"}),
        (6, 1, 9, {"vendor": "", "expiration_date": ""}), (6, 2, 9, {"vendor": "later"}), (99, 1, 9, {"vendor": "x"}),
        (7, 1, 9, {"execution_status": "supporting"}),
        # a valid correction after an invalid one; two at one place; one that is wrong only after those before it
        (3, 2, 8, {"document_type": "NDA"}), (3, 3, 8, {"vendor": "B"}), (3, 3, 7, {"vendor": "A", "mark_reviewed": "1"}),
        (3, 4, 8, {"expiration_date": "2024-06-01"}), (3, 5, 8, {"effective_date": "2024-07-01"}), (3, 6, 8, None),
    ], "doc_id long, seq int, reviewer_id long, fields map<string,string>")
    now = datetime(2024, 6, 1)
    checked = corrections.checked_corrections(docs, patches)
    errors = {(r["doc_id"], r["seq"]): r["error"] for r in corrections.rejected_corrections(checked).collect()}
    assert errors == {
        (2, 1): "expiration_date cannot be before effective_date", (3, 1): "Invalid document_type",
        (4, 1): "review_notes is too long", (5, 1): "effective_date must be YYYY-MM-DD",
        (99, 1): "Document not found", (3, 5): "expiration_date cannot be before effective_date",
        (7, 1): "Invalid execution_status",
    }
    out = {r["doc_id"]: r for r in corrections.apply_corrections(docs, checked, now).collect()}
    assert len(out) == 7
    assert (out[1]["document_type"], out[1]["vendor"], out[1]["review_status"], out[1]["reviewed_by_id"], out[1]["reviewed_at"]) == (
        "NDA", "New", "reviewed", 9, now)
    assert out[6]["vendor"] == "later" and out[2]["expiration_date"] is None
    assert (out[3]["document_type"], out[3]["vendor"], out[3]["expiration_date"], out[3]["effective_date"]) == (
        "NDA", "B", date(2024, 6, 1), start)
    assert (out[3]["review_status"], out[3]["reviewed_by_id"]) == ("reviewed", 7)
    changes = [(r["doc_id"], r["field"], r["old_value"], r["new_value"]) for r in corrections.correction_changes(checked).collect()]
    assert sorted(c for c in changes if c[0] == 1) == [
        (1, "document_type", "MSA", "NDA"), (1, "review_status", "needs_review", "reviewed"), (1, "vendor", "Acme", "New")]
    assert {c for c in changes if c[1] == "vendor" and c[0] != 1} == {
        (6, "vendor", "Acme", None), (6, "vendor", None, "later"), (3, "vendor", "Acme", "A"), (3, "vendor", "A", "B")}


# --- corpus ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,train", [(0, 0), (9, 9), (10, 9), (11, 9), (105, 94)])
def test_split(spark, n, train):
    df = spark.range(n).select(F.col("id").alias("doc_id"))
    got = corpus.train_eval_split(df).collect()
    assert sorted(r["doc_id"] for r in got if r["split"] == "train") == list(range(train)) and len(got) == n


def test_folded_corrections_equal_those_in_order(spark, monkeypatch):
    """Random corrections of a few documents, some with many, by the fold and one after the other."""
    rnd = random.Random(12)
    days = [None, "2024-01-01", "2024-06-01", "2024-12-31", "soon", ""]
    schema = (
        "doc_id long, tenant_id long, document_type string, execution_status string, retention_category string, vendor string, "
        "review_notes string, effective_date date, expiration_date date, renewal_date date, review_date date, "
        "termination_date date, review_status string, reviewed_by_id long, reviewed_at timestamp"
    )
    docs = spark.createDataFrame([
        (i, 1, "MSA", "final", None, "Acme", None, date(2024, 5, 1), date(2024, 4, 1) if i % 3 == 0 else None, None, None, None,
         "needs_review", None, None) for i in range(12)], schema)
    rows = []
    for n in range(300):
        fields = {k: v for k in ("effective_date", "expiration_date") if (v := rnd.choice(days)) is not None and rnd.random() < 0.5}
        fields |= {"vendor": rnd.choice(["A", "", " B "])} if rnd.random() < 0.4 else {}
        fields |= {"document_type": rnd.choice(["nda", "bad", ""])} if rnd.random() < 0.3 else {}
        fields |= {"mark_reviewed": "true"} if rnd.random() < 0.1 else {}
        rows.append((rnd.choice([0, 0, 0, *range(14), None]), n // 4, rnd.randint(1, 3), fields or None))
    patches = spark.createDataFrame(rows, "doc_id long, seq int, reviewer_id long, fields map<string,string>")
    found = []
    for fold in (0, 20, 200):
        monkeypatch.setattr(corrections, "FOLD", fold)
        checked = corrections.checked_corrections(docs, patches)
        if fold == 200:
            plan = checked._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" not in plan
        found.append(Counter(tuple(r) for r in checked.withColumn("fields", F.to_json("fields")).collect()))
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == 300


def test_corrections_are_joined_and_sorted_once(spark):
    """The fold, the places and the states share one join with the documents and one sort."""
    schema = (
        "doc_id long, tenant_id long, document_type string, execution_status string, retention_category string, vendor string, "
        "review_notes string, effective_date date, expiration_date date, renewal_date date, review_date date, "
        "termination_date date, review_status string, reviewed_by_id long, reviewed_at timestamp"
    )
    docs = spark.createDataFrame([(1, 1, "MSA", "final", None, "Acme", None, date(2024, 5, 1), None, None, None, None, "needs_review", None, None)], schema)
    patches = spark.createDataFrame([
        (1, 2, 9, {"expiration_date": "2024-04-30"}), (1, 1, 9, {"vendor": "A", "mark_reviewed": "1"}), (1, 3, 9, {"expiration_date": "2024-06-30"}),
        (None, 1, 9, {"vendor": "x"}),
    ], "doc_id long, seq int, reviewer_id long, fields map<string,string>")
    checked = corrections.checked_corrections(docs, patches)
    found = sorted((r["seq"], r["error"], r["applied"], r["vendor"], r["expiration_date"]) for r in checked.collect() if r["doc_id"])
    wrong = "expiration_date cannot be before effective_date"
    assert found == [(1, None, 1, "Acme", None), (2, wrong, None, "A", None), (3, None, 2, "A", None)]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
