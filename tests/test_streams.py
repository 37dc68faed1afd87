"""Streams against their batch forms, including late and repeated rows."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketlake.operators import jobs, rates
from docketlake.sources.sinks import Manifest, publish_results, read_failed, read_published
from docketlake.streaming import jobs as streams

BASE = datetime(2024, 1, 1)


def arrivals(spark, path, batches, schema):
    """One file per batch, read one file at a time in writing order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_leases_close_after_the_watermark(spark, tmp_path):
    def beat(job, *seconds):
        return [(job, BASE + timedelta(seconds=s)) for s in seconds]

    batches = [beat(1, 0, 60, 120), beat(2, 100), beat(1, 1000), beat(3, 2000)]
    source = arrivals(spark, str(tmp_path / "in"), batches, "job_id long, heartbeat_at timestamp")
    got = streams.run_to_files(streams.lease_expiry_stream(source), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = {(r["job_id"], r["lease_expired_at"], r["heartbeats"]) for r in got.collect()}
    at = lambda s: BASE + timedelta(seconds=s)
    assert rows == {(1, at(210), 3), (2, at(190), 1), (1, at(1090), 1)}  # job 3 may still renew
    every = spark.createDataFrame([r for b in batches for r in b], "job_id long, heartbeat_at timestamp")
    batch = {(r["job_id"], r["lease_expired_at"], r["heartbeats"]) for r in jobs.lease_periods(every).collect()}
    assert rows == {r for r in batch if r[0] != 3}


def test_transitions_drop_late_rows(spark, tmp_path):
    def change(minutes, status):
        return [(BASE + timedelta(minutes=minutes), status)]

    batches = [change(5, "queued"), change(10, "queued"), change(200, "failed"), change(210, "failed"),
               change(6, "queued"), change(400, "failed")]
    source = arrivals(spark, str(tmp_path / "in"), batches, "changed_at timestamp, status string")
    got = streams.run_to_files(streams.job_transitions_stream(source), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r["window_start"], r["status"], r["transitions"]) for r in got.collect()} == {
        (BASE, "queued", 2), (BASE + timedelta(minutes=180), "failed", 2),
    }


def test_rate_stream_keeps_state_between_batches(spark, tmp_path):
    def ask(first, *seconds):
        return [(first + i, "auth", "c", BASE + timedelta(seconds=s)) for i, s in enumerate(seconds)]

    batches = [ask(0, 0, 1), ask(10, 30, 59), ask(20, 60, 61), ask(30, 62)]
    schema = "request_id long, bucket string, client string, seen_at timestamp"
    source = arrivals(spark, str(tmp_path / "in"), batches, schema)
    stream = streams.sliding_rate_stream(source, {"auth": 2}, watermark="0 seconds")
    got = streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r["request_id"] for r in rates.sliding_rate_violations(every, {"auth": 2}).collect()}
    assert {r["request_id"] for r in got.collect()} == want == {10, 11, 30}


REQUESTS = "request_id long, bucket string, client string, seen_at timestamp"


def requests_at_random(seed, count, pause):
    """Requests of three clients, one without name, with equal times, a pause and a bucket without limit."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        second = rng.randrange(count) + (pause if i % 2 else 0)
        client = rng.choice(["a", "b", None])
        out.append((i, rng.choice(["auth", "auth", "upload", "free"]), client, BASE + timedelta(seconds=second)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_stream_equals_batch_in_any_arrival_order(spark, tmp_path, seed):
    rows = requests_at_random(seed, 240, 1000)
    limits, last = {"auth": 3, "upload": 5, "free": 0}, max(r[3] for r in rows)
    random.Random(seed + 10).shuffle(rows)
    closing = (999, "free", "z", last + timedelta(seconds=3000))
    unlimited = (1000, "auth", "z", last + timedelta(seconds=3001))  # carries the watermark beyond all the others
    source = arrivals(spark, str(tmp_path / "in"), [rows[:90], rows[90:170], rows[170:], [closing, unlimited]], REQUESTS)
    stream = streams.sliding_rate_stream(source, limits, watermark="2500 seconds")
    got = streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    batch = rates.sliding_rate_violations(spark.createDataFrame(rows, REQUESTS), limits).collect()
    assert len(batch) > 10 and Counter(map(tuple, got)) == Counter(map(tuple, batch))
    assert "unknown" in {r["client"] for r in got}


def test_requests_30_seconds_apart_are_never_refused(spark, tmp_path):
    rows = [(i, "auth", "c", BASE + timedelta(seconds=30 * i)) for i in range(60)]
    random.Random(3).shuffle(rows)
    source = arrivals(spark, str(tmp_path / "in"), [rows[:30], rows[30:]], REQUESTS)
    stream = streams.sliding_rate_stream(source, {"auth": 3}, watermark="1 hour")
    assert streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).count() == 0


def test_idle_clients_leave_the_state_and_late_rows_are_dropped(spark, tmp_path):
    def ask(i, client, second):
        return (i, "auth", client, BASE + timedelta(seconds=second))

    batches = [[ask(i, f"c{i}", i) for i in range(20)], [ask(100, "x", 10_000)], [ask(101, "x", 20_000)],
               [ask(102, "c1", 1), ask(103, "c1", 1)], [ask(104, "x", 30_000)]]
    source = arrivals(spark, str(tmp_path / "in"), batches, REQUESTS)
    query = streams.sliding_rate_stream(source, {"auth": 1}, watermark="10 seconds").writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "accepted").load(str(tmp_path / "state"))
    assert {r["key"]["client"] for r in state.select("key").collect()} == set()
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert {r["key"]["client"] for r in waiting.select("key").collect()} == {"x"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # the late ones do not count


def test_rate_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(i, "auth", "c", BASE + timedelta(seconds=i)) for i in range(12)]
    for part in (rows[:4], rows[4:8], rows[8:]):
        source = arrivals(spark, str(tmp_path / "in"), [part], REQUESTS)
        stream = streams.sliding_rate_stream(source, {"auth": 3}, seconds=6, watermark="0 seconds")
        got = streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["request_id"] for r in got.collect()} == {3, 4, 5, 9, 10, 11}


ARRIVALS = "doc_id long, path string, folder string, original_name string, text string, arrived_at timestamp"


def version_of(doc_id, text, minute):
    return (doc_id, f"/x/{doc_id}", "Acme", f"{doc_id}.txt", text, BASE + timedelta(minutes=minute))


def test_newest_version_of_a_batch_is_published(spark, tmp_path):
    rows = [version_of(1, "Purchase order", 1), version_of(1, "Amendment", 9), version_of(1, "Statement of Work", 5)]
    for turn, order in enumerate(itertools.permutations(rows)):
        folder = tmp_path / str(turn)
        source = arrivals(spark, str(folder / "in"), [list(order)], ARRIVALS)
        streams.stream_intake(source, str(folder / "out"), str(folder / "state")).awaitTermination()
        assert [r["document_type"] for r in read_published(spark, str(folder / "out")).collect()] == ["AMD"]


def test_restarted_intake_does_not_lose_to_an_old_one(spark, tmp_path):
    out = str(tmp_path / "out")
    old = [[version_of(i, "Purchase order", n)] for n, i in enumerate((1, 2, 1, 2))]  # batches 0 to 3
    for turn, batches in enumerate((old, [[version_of(1, "Amendment", 50)]])):
        source = arrivals(spark, str(tmp_path / f"in{turn}"), batches, ARRIVALS)
        streams.stream_intake(source, out, str(tmp_path / f"state{turn}")).awaitTermination()
    got = {r["doc_id"]: r["document_type"] for r in read_published(spark, out).collect()}
    assert got == {1: "AMD", 2: "PO"}


def test_versions_follow_publication_and_not_batch_numbers(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "doc_id long, new_filename string, v string, error string"

    def publish(v, batch_id, stream, error=None):
        publish_results(spark.createDataFrame([(1, "a", v, error)], schema), path, batch_id, stream)

    publish("stale", 50, "old-run")
    publish("fresh", 0, "restart")
    assert [r["v"] for r in read_published(spark, path).collect()] == ["fresh"]
    publish("stale again", 50, "old-run")  # repeated after a failure: keeps its place
    assert [r["v"] for r in read_published(spark, path).collect()] == ["fresh"]
    publish("broken", 1, "restart", "no text")
    assert [r["v"] for r in read_published(spark, path).collect()] == ["fresh"]
    assert [(r["v"], r["error"]) for r in read_failed(spark, path).collect()] == [("broken", "no text")]
    # written, but never entered: not published
    spark.createDataFrame([(2, "a", "half", None, 0)], schema + ", failed int").write.partitionBy("failed").parquet(
        f"{path}/stream=restart/batch_id=2")
    assert {r["doc_id"] for r in read_published(spark, path).collect()} == {1}
    versions = [r["version"] for r in Manifest(spark, path).entries().orderBy("version").collect()]
    assert versions == [1, 2, 3]


def test_failed_documents_are_analysed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def analyse(docs):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        counted = docs.mapInPandas(count, docs.schema)
        return counted.withColumn("error", F.when(F.col("doc_id") == 2, "bad"))

    source = arrivals(spark, str(tmp_path / "in"), [[version_of(1, "x", 1), version_of(2, "y", 1)]], ARRIVALS)
    streams.stream_intake(source, str(tmp_path / "out"), str(tmp_path / "state"), analyse).awaitTermination()
    assert seen.value == 2
    assert {r["doc_id"] for r in read_published(spark, str(tmp_path / "out")).collect()} == {1}
    assert {r["doc_id"] for r in read_failed(spark, str(tmp_path / "out")).collect()} == {2}


def test_intake_publishes_each_document_once(spark, tmp_path):
    def arrive(minute, *ids):
        return [(i, f"/x/{i}", "Acme", f"{i}.txt", "Purchase order", BASE + timedelta(minutes=minute)) for i in ids]

    schema = "doc_id long, path string, folder string, original_name string, text string, arrived_at timestamp"
    source = arrivals(spark, str(tmp_path / "in"), [arrive(5000, 1, 2), arrive(1, 2, 3), arrive(2, 1)], schema)
    streams.stream_intake(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    # late by a day and delivered twice: nothing is lost, readers see each document once
    got = read_published(spark, str(tmp_path / "out")).collect()
    assert {(r["doc_id"], r["document_type"]) for r in got} == {(1, "PO"), (2, "PO"), (3, "PO")}
