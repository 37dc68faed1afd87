"""Processing jobs and their attempts: health, latency, recovery, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from docketlake import fixed
from docketlake.functions.doctype import failure_code
from docketlake.operators.ordered import running_total
from docketlake.session import Rounds, cut


_ATTEMPT = ("attempt_number", "status", "started_at", "finished_at", "duration_ms", "retryable", "error_code")


def _with_document(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    document = docs.select(
        F.col("doc_id").alias("document_id"),
        F.struct("doc_id", "original_name", "document_type", "status").alias("document"),
    )
    return jobs.join(document, "document_id", "left")


def jobs_with_attempts(jobs: DataFrame, attempts: DataFrame, docs: DataFrame) -> DataFrame:
    """Each job with its document and total duration, one row per attempt (``attempt``).

    Totals are summed before the shuffle.  Attempts drive the join, so a job with
    very many of them is split like any skewed key; jobs without attempts are added.
    """
    spent = attempts.groupBy("job_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"))
    known = _with_document(jobs, docs).join(spent, "job_id", "left")
    rows = attempts.select("job_id", F.struct(*_ATTEMPT).alias("attempt"))
    tried = known.where("duration_ms is not null")
    never = known.where("duration_ms is null").withColumn("duration_ms", F.lit(0).cast("long"))
    return rows.join(tried, "job_id").unionByName(never, allowMissingColumns=True)


def job_detail(jobs: DataFrame, attempts: DataFrame, docs: DataFrame, job_id: int) -> DataFrame:
    """One job with its document and the list of its attempts, in order."""
    one = _with_document(jobs.where(F.col("job_id") == job_id), docs)
    history = attempts.where(F.col("job_id") == job_id).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct(*_ATTEMPT))).alias("attempt_history"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"),
    )
    return one.join(history, "job_id", "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "metric", "value")


def job_metrics(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Active, retried, succeeded and failed counts in long form."""
    status = F.col("status")
    return _long(jobs.agg(
        F.count_if(status == "processing").alias("active"),
        F.count_if(status == "completed").alias("success"),
        F.count_if(status == "failed").alias("failure"),
    )).unionByName(_long(attempts.agg(
        F.count_if(status.isin("retry_scheduled", "abandoned")).alias("retries"),
    )))


def duration_histogram(attempts: DataFrame, buckets=fixed.DURATION_BUCKETS) -> DataFrame:
    """Cumulative counts of completed attempts by duration, with count and sum.

    All buckets are counted in one pass; nothing is multiplied by the buckets.
    """
    seconds = F.col("duration_ms") / 1000.0
    counts = [F.count_if(seconds <= b).cast("double").alias(f"le_{b}") for b in buckets]
    return _long(
        attempts.where((F.col("status") == "completed") & F.col("duration_ms").isNotNull()).agg(
            *counts,
            F.count(F.lit(1)).cast("double").alias("le_inf"),
            F.count(F.lit(1)).cast("double").alias("count"),
            F.coalesce(F.round(F.sum("duration_ms") / 1000.0, 3), F.lit(0.0)).alias("sum"),
        )
    )


def nearest_rank(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Exact nearest-rank percentile of a whole-number column; one row, 0 when empty.

    Values are counted first; the running total over all distinct values is
    computed slice by slice, not in one task.
    """
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    ))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = min(total, max(1, int(total * fraction + 0.999)))
    reached = running_total(counted, [], ["v"], F.col("n"), "reached")
    return reached.where(F.col("reached") >= rank).agg(F.coalesce(F.min("v"), F.lit(0)).alias(value))


def _millis(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 1000)


def throughput_report(jobs: DataFrame, attempts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row on finished jobs: rate, latencies, retries, failures, distinct results."""
    spent = attempts.groupBy("job_id").agg(
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("attempt_ms"),
        F.count(F.lit(1)).alias("tries"),
    )
    results = docs.select(F.col("doc_id").alias("document_id"), "result_storage_key", "generated_filename")
    finished = (
        jobs.where(F.col("status").isin("completed", "failed"))
        .join(spent, "job_id", "left").join(results, "document_id", "left")
    )
    own_time = F.greatest(F.lit(0), _millis(F.col("finished_at"), F.col("started_at")))
    identity = F.coalesce(
        F.when(F.col("result_storage_key") != "", F.col("result_storage_key")),
        F.when(F.col("generated_filename") != "", F.col("generated_filename")),
        F.concat(F.lit("document-"), F.col("document_id")),
    )
    # narrow, and read by every part of the report
    measured = cut(finished.select(
        "job_id", "status", "created_at", "finished_at",
        F.coalesce("attempt_ms", own_time, F.lit(0)).cast("long").alias("processing_ms"),
        _millis(F.col("finished_at"), F.col("created_at")).cast("long").alias("end_to_end_ms"),
        F.greatest(F.lit(0), F.coalesce(F.col("tries"), F.lit(0)) - 1).alias("retries"),
        F.when(F.col("status") == "completed", identity).alias("result"),
        ((F.col("status") == "completed") & F.col("result_storage_key").isNotNull()).alias("downloadable"),
    ))
    drain = (F.unix_micros(F.max("finished_at")) - F.unix_micros(F.min("created_at"))) / 1e6
    successes = F.count_if(F.col("status") == "completed")
    totals = measured.agg(
        successes.alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.round(F.try_divide(successes * 60.0, drain), 6).alias("documents_per_minute"),
        F.round(F.coalesce(F.try_divide(F.sum("processing_ms"), F.count("processing_ms")), F.lit(0.0)) / 1000, 3)
        .alias("processing_avg_s"),
        F.round(F.coalesce(F.try_divide(F.sum("end_to_end_ms"), F.count("end_to_end_ms")), F.lit(0.0)) / 1000, 3)
        .alias("end_to_end_avg_s"),
        F.count_if("downloadable").alias("downloadable_results"),
    )
    unique = measured.where("result is not null").groupBy("result").agg(F.lit(1)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return totals.select(
        "*",
        (nearest_rank(measured, "processing_ms", 0.95).scalar() / 1000.0).alias("processing_p95_s"),
        (nearest_rank(measured, "end_to_end_ms", 0.95).scalar() / 1000.0).alias("end_to_end_p95_s"),
        unique.scalar().alias("unique_results"),
    )


def max_concurrency(attempts: DataFrame) -> DataFrame:
    """Largest number of attempts running at the same instant.

    Starts and ends are netted per instant first; the running total over all
    instants is computed slice by slice, not in one task.
    """
    edges = F.array(
        F.struct(F.col("started_at").alias("at"), F.lit(1).cast("long").alias("delta")),
        F.struct(F.col("finished_at").alias("at"), F.lit(-1).cast("long").alias("delta")),
    )
    steps = (
        attempts.where("started_at is not null and finished_at is not null")
        .select(F.inline(edges)).groupBy("at").agg(F.sum("delta").alias("delta"))
    )
    running = running_total(cut(steps), [], ["at"], F.col("delta"), "active")
    return running.agg(F.coalesce(F.max("active"), F.lit(0)).alias("max_concurrency"))


def latest_active_child(jobs: DataFrame) -> DataFrame:
    """Newest unfinished redrive of every job that has one."""
    active = jobs.where(
        F.col("status").isin(*fixed.ACTIVE_JOB_STATUSES) & F.col("parent_job_id").isNotNull()
    )
    return active.groupBy("parent_job_id").agg(F.max("job_id").alias("active_child_id"))


def redrive_candidates(jobs: DataFrame) -> DataFrame:
    """Failed jobs; those without an unfinished redrive may get a new one."""
    child = latest_active_child(jobs).withColumnRenamed("parent_job_id", "job_id")
    return jobs.where(F.col("status") == "failed").join(child, "job_id", "left").select(
        "job_id", "document_id", "active_child_id", F.col("active_child_id").isNull().alias("can_redrive")
    )


def job_lineage(jobs: DataFrame, job_id: int | None = None) -> DataFrame:
    """First job (root) of every job's redrive chain and the distance to it.

    Pointer doubling: in each round a job takes over the pointer of the job it
    points to, so a chain of n jobs needs about log2(n) joins.  A job whose pointer
    is its root is settled: it is written once and only read from then on, and each
    round writes the open jobs alone.  Jobs in a cycle have no root: they stay with
    a null root.
    """
    ids = jobs.select("job_id", "parent_job_id")
    parents = ids.select(F.col("job_id").alias("parent_job_id"), F.lit(True).alias("_exists"))
    table = Rounds(jobs.sparkSession, "lineage", "job_id long, pointer long, depth long, done boolean")
    part = ids.join(parents, "parent_job_id", "left").select(
        F.col("job_id").cast("long").alias("job_id"),
        F.when(F.col("_exists"), F.col("parent_job_id")).otherwise(F.col("job_id")).cast("long").alias("pointer"),
        F.when(F.col("_exists"), 1).otherwise(0).cast("long").alias("depth"),
        F.col("_exists").isNull().alias("done"),
    )
    rounds = None
    while True:
        seen = Observation()
        table.add(part.observe(seen, F.count_if(~F.col("done")).alias("left")))
        left = seen.get["left"]
        known = table.read()
        current = F.col("done") | (F.col("round") == table.last)
        # as many rounds as the longest possible chain needs; what is open then lies in a cycle
        rounds = max(1, left.bit_length()) + 1 if rounds is None else rounds - 1
        if not left or not rounds:
            break
        target = known.where(current).select(
            F.col("job_id").alias("pointer"), F.col("pointer").alias("_next"),
            F.col("depth").alias("_more"), F.col("done").alias("_root_known"),
        )
        part = known.where(~F.col("done") & (F.col("round") == table.last)).join(target, "pointer").select(
            "job_id", F.col("_next").alias("pointer"), (F.col("depth") + F.col("_more")).alias("depth"),
            F.col("_root_known").alias("done"),
        )
    result = known.where(current).select(
        "job_id",
        F.when(F.col("done"), F.col("pointer")).alias("root_job_id"),
        F.when(F.col("done"), F.col("depth")).alias("depth"),
    )
    return result if job_id is None else result.where(F.col("job_id") == job_id)


def failure_taxonomy(attempts: DataFrame) -> DataFrame:
    """Add code, retryability and safe message of each failed attempt's exception class."""
    failed = attempts.where(F.col("error_class").isNotNull())
    return failed.withColumn("_f", failure_code(F.col("error_class"))).select(
        "*", F.col("_f.error_code").alias("failure_code"),
        F.col("_f.retryable").alias("failure_retryable"), F.col("_f.message").alias("failure_message"),
    ).drop("_f")


def retry_plan(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """What follows a failed attempt: a retry after 10, then 60 seconds, or the end."""
    limits = jobs.select("job_id", "max_attempts")
    failed = failure_taxonomy(attempts).join(limits, "job_id")
    again = F.col("failure_retryable") & (F.col("attempt_number") < F.col("max_attempts"))
    first, later = fixed.RETRY_DELAYS
    delay = F.when(F.col("attempt_number") <= 1, first).otherwise(later)
    return failed.select(
        "job_id", "attempt_number", "failure_code", "failure_message",
        again.alias("retryable"),
        F.when(again, "retry_scheduled").otherwise("failed").alias("next_status"),
        F.when(again, F.timestamp_add("SECOND", delay, F.col("finished_at"))).alias("retry_at"),
    )


def stale_leases(
    jobs: DataFrame, attempts: DataFrame, as_of, lease_seconds: int = fixed.LEASE_SECONDS
) -> DataFrame:
    """Processing jobs without a recent heartbeat: requeued, or failed after the last attempt."""
    now = F.lit(as_of).cast("timestamp")
    limit = now - F.make_dt_interval(secs=F.lit(lease_seconds))
    stale = jobs.where(
        (F.col("status") == "processing")
        & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < limit))
    ).select("job_id", "document_id", "tenant_id", "attempts", "max_attempts")
    current = attempts.where(F.col("status") == "processing").select(
        "job_id", F.col("attempt_number").alias("attempts"), "started_at"
    )
    over = F.col("attempts") >= F.col("max_attempts")
    running = F.col("started_at").isNotNull()
    spent = F.greatest(F.lit(0), _millis(now, F.col("started_at")))
    return stale.join(current, ["job_id", "attempts"], "left").select(
        "job_id", "document_id", "tenant_id", F.col("attempts").alias("attempt_number"),
        F.when(over, "failed").otherwise("requeued").alias("outcome"),
        F.when(over, "failed").otherwise("pending").alias("job_status"),
        F.when(running, "abandoned").alias("attempt_status"),
        F.when(running, ~over).alias("attempt_retryable"),
        F.when(running, "worker_lost").alias("error_code"),
        F.when(running, spent).alias("duration_ms"),
    )


def stale_lease_counts(stale: DataFrame) -> DataFrame:
    return stale.groupBy("outcome").agg(F.count(F.lit(1)).alias("jobs"))


def job_transitions(changes: DataFrame, minutes: int = 60) -> DataFrame:
    """Transitions per status and tumbling window."""
    return changes.groupBy(F.window("changed_at", f"{minutes} minutes"), "status").agg(
        F.count(F.lit(1)).alias("transitions")
    ).select(F.col("window.start").alias("window_start"), "status", "transitions")


def lease_periods(heartbeats: DataFrame, lease_seconds: int = fixed.LEASE_SECONDS) -> DataFrame:
    """Unbroken heartbeat periods per job and the moment each lease ran out.

    ``session_window`` with local merging ships periods, not single heartbeats.
    """
    period = F.session_window("heartbeat_at", f"{lease_seconds} seconds")
    return heartbeats.groupBy("job_id", period).agg(F.count(F.lit(1)).alias("heartbeats")).select(
        "job_id", F.col("session_window.start").alias("first_heartbeat"),
        F.col("session_window.end").alias("lease_expired_at"), "heartbeats",
    )
