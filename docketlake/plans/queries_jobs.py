"""Queries on jobs, attempts, leases and request rates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docketlake import fixed
from docketlake.functions.text import iso_timestamp
from docketlake.operators import jobs, rates
from docketlake.plans.catalog import Data, number, query

AS_OF = datetime(1998, 1, 1)


SPENT = "(select job_id, sum(coalesce(duration_ms, 0)) as duration_ms from attempts group by job_id)"


@query("jobs_with_attempts", f"""
select j.job_id, j.document_id, j.status, cast(coalesce(s.duration_ms, 0) as bigint) as duration_ms, cast(a.attempt_number as bigint) as attempt_number,
 a.status as attempt_status, a.duration_ms as attempt_duration_ms, a.retryable, c.original_name
from jobs j left join {SPENT} s on s.job_id = j.job_id left join attempts a on a.job_id = j.job_id left join contracts c on c.doc_id = j.document_id""")
def jobs_with_attempts(d: Data):
    full = jobs.jobs_with_attempts(d.jobs, d.attempts, d.contracts)
    return full.select(
        "job_id", "document_id", "status", "duration_ms",
        F.col("attempt.attempt_number").cast("long").alias("attempt_number"),
        F.col("attempt.status").alias("attempt_status"), F.col("attempt.duration_ms").alias("attempt_duration_ms"),
        "attempt.retryable", "document.original_name",
    )


@query("job_detail", """
select j.job_id, j.status, cast(a.duration_ms as bigint) as duration_ms, a.history, c.original_name
from jobs j left join (select job_id, sum(coalesce(duration_ms, 0)) as duration_ms,
 string_agg(cast(attempt_number as varchar) || ':' || status, ',' order by attempt_number) as history from attempts group by job_id) a
 on a.job_id = j.job_id left join contracts c on c.doc_id = j.document_id where j.job_id = 26""")
def job_detail(d):
    full = jobs.job_detail(d.jobs, d.attempts, d.contracts, 26)
    history = F.transform("attempt_history", lambda a: F.concat_ws(":", a["attempt_number"], a["status"]))
    return full.select(
        "job_id", "status", "duration_ms", F.array_join(history, ",").alias("history"), "document.original_name"
    )


@query("job_metrics", """
select 'active' as metric, count(*) filter (where status = 'processing') as value from jobs union all
select 'success', count(*) filter (where status = 'completed') from jobs union all
select 'failure', count(*) filter (where status = 'failed') from jobs union all
select 'retries', count(*) filter (where status in ('retry_scheduled', 'abandoned')) from attempts""")
def job_metrics(d):
    return jobs.job_metrics(d.jobs, d.attempts)


DONE = "from attempts where status = 'completed' and duration_ms is not null"


@query("duration_histogram", " union all ".join(
    [f"select 'le_{b}' as metric, cast(count(*) filter (where duration_ms / 1000.0 <= {b}) as double) as value {DONE}"
     for b in fixed.DURATION_BUCKETS]
    + [f"select 'le_inf', cast(count(*) as double) {DONE}", f"select 'count', cast(count(*) as double) {DONE}",
       f"select 'sum', coalesce(round(cast(sum(duration_ms) as double) / 1000.0, 3), 0.0) {DONE}"]
))
def duration_histogram(d):
    return jobs.duration_histogram(d.attempts)


@query("throughput_report", """
with spent as (select job_id, sum(coalesce(duration_ms, 0)) as ms, count(*) as tries from attempts group by job_id),
m as (select j.status, j.created_at, j.finished_at,
 cast(coalesce(s.ms, greatest(0, date_diff('millisecond', j.started_at, j.finished_at)), 0) as bigint) as p,
 cast(date_diff('millisecond', j.created_at, j.finished_at) as bigint) as e,
 greatest(0, coalesce(s.tries, 0) - 1) as retries,
 case when j.status = 'completed' then coalesce(c.result_storage_key, c.generated_filename, 'document-' || cast(j.document_id as varchar)) end as result,
 j.status = 'completed' and c.result_storage_key is not null as downloadable
 from jobs j left join spent s on s.job_id = j.job_id left join contracts c on c.doc_id = j.document_id
 where j.status in ('completed', 'failed')),
rp as (select p, row_number() over (order by p) as rn, count(*) over () as n from m),
re as (select e, row_number() over (order by e) as rn, count(*) over () as n from m where e is not null)
select count(*) filter (where status = 'completed') as successful, count(*) filter (where status = 'failed') as failures,
 cast(sum(retries) as bigint) as retries,
 round(count(*) filter (where status = 'completed') * 60.0 / (date_diff('microsecond', min(created_at), max(finished_at)) / 1e6), 6) as documents_per_minute,
 round(cast(sum(p) as double) / count(p) / 1000, 3) as processing_avg_s, round(cast(sum(e) as double) / count(e) / 1000, 3) as end_to_end_avg_s,
 count(*) filter (where downloadable) as downloadable_results,
 (select max(p) from rp where rn = least(n, greatest(1, cast(floor(n * 0.95 + 0.999) as bigint)))) / 1000.0 as processing_p95_s,
 (select max(e) from re where rn = least(n, greatest(1, cast(floor(n * 0.95 + 0.999) as bigint)))) / 1000.0 as end_to_end_p95_s,
 count(distinct result) as unique_results
from m""")
def throughput_report(d):
    return jobs.throughput_report(d.jobs, d.attempts, d.contracts)


@query("max_concurrency", """
select cast(max(active) as bigint) as max_concurrency from (select sum(delta) over (order by moment) as active from (
 select moment, sum(delta) as delta from (select started_at as moment, 1 as delta from attempts where started_at is not null and finished_at is not null
 union all select finished_at, -1 from attempts where started_at is not null and finished_at is not null) x group by moment) y) z""")
def max_concurrency(d):
    return jobs.max_concurrency(d.attempts)


ACTIVE = ", ".join(f"'{s}'" for s in fixed.ACTIVE_JOB_STATUSES)


@query("latest_active_child", f"""
select parent_job_id, max(job_id) as active_child_id from jobs
where status in ({ACTIVE}) and parent_job_id is not null group by parent_job_id""")
def latest_active_child(d):
    return jobs.latest_active_child(d.jobs)


@query("redrive_candidates", f"""
select j.job_id, j.document_id, c.active_child_id, c.active_child_id is null as can_redrive
from jobs j left join (select parent_job_id, max(job_id) as active_child_id from jobs where status in ({ACTIVE}) group by parent_job_id) c
on c.parent_job_id = j.job_id where j.status = 'failed'""")
def redrive_candidates(d):
    return jobs.redrive_candidates(d.jobs)


@query("job_lineage", """
with recursive chain as (
 select job_id, job_id as root_job_id, cast(0 as bigint) as depth from jobs where parent_job_id is null
 union all
 select j.job_id, c.root_job_id, c.depth + 1 from chain c join jobs j on j.parent_job_id = c.job_id)
select job_id, root_job_id, depth from chain""")
def job_lineage(d):
    return jobs.job_lineage(d.jobs)


def _failure_case(index):
    def text(v):
        return str(v).lower() if isinstance(v, bool) else f"'{v}'"

    whens = " ".join(f"when '{k}' then {text(v[index])}" for k, v in fixed.FAILURES.items())
    return f"case error_class {whens} else {text(fixed.DEFAULT_FAILURE[index])} end"


@query("failure_taxonomy", f"""
select job_id, cast(attempt_number as bigint) as attempt_number, error_class, {_failure_case(0)} as failure_code,
 {_failure_case(1)} as failure_retryable, {_failure_case(2)} as failure_message from attempts where error_class is not null""")
def failure_taxonomy(d):
    return number(jobs.failure_taxonomy(d.attempts), "attempt_number").select(
        "job_id", "attempt_number", "error_class", "failure_code", "failure_retryable", "failure_message"
    )


@query("retry_plan", f"""
select a.job_id, cast(attempt_number as bigint) as attempt_number, {_failure_case(0)} as failure_code, {_failure_case(2)} as failure_message,
 {_failure_case(1)} and attempt_number < max_attempts as retryable,
 case when {_failure_case(1)} and attempt_number < max_attempts then 'retry_scheduled' else 'failed' end as next_status,
 case when {_failure_case(1)} and attempt_number < max_attempts then
  strftime(a.finished_at + to_seconds(case when attempt_number <= 1 then 10 else 60 end), '%Y-%m-%dT%H:%M:%S') end as retry_at
from attempts a join jobs j on j.job_id = a.job_id where error_class is not null""")
def retry_plan(d):
    return number(jobs.retry_plan(d.attempts, d.jobs), "attempt_number").withColumn(
        "retry_at", iso_timestamp(F.col("retry_at"))
    )


STALE = """
with stale as (select j.job_id, j.document_id, j.tenant_id, cast(j.attempts as bigint) as attempt_number,
 case when j.attempts >= j.max_attempts then 'failed' else 'requeued' end as outcome,
 case when j.attempts >= j.max_attempts then 'failed' else 'pending' end as job_status,
 case when a.job_id is not null then 'abandoned' end as attempt_status,
 case when a.job_id is not null then j.attempts < j.max_attempts end as attempt_retryable,
 case when a.job_id is not null then 'worker_lost' end as error_code,
 case when a.job_id is not null then greatest(0, date_diff('millisecond', a.started_at, timestamp '1998-01-01 00:00:00')) end as duration_ms
from jobs j left join attempts a on a.job_id = j.job_id and a.attempt_number = j.attempts and a.status = 'processing'
where j.status = 'processing' and (j.heartbeat_at is null or j.heartbeat_at < timestamp '1998-01-01 00:00:00' - interval 90 seconds))
"""


@query("stale_leases", STALE + "select * from stale")
def stale_leases(d):
    return number(jobs.stale_leases(d.jobs, d.attempts, AS_OF), "attempt_number")


@query("stale_lease_counts", STALE + "select outcome, count(*) as jobs from stale group by outcome")
def stale_lease_counts(d):
    return jobs.stale_lease_counts(jobs.stale_leases(d.jobs, d.attempts, AS_OF))


LEASES = """
select job_id, strftime(min(heartbeat_at), '%Y-%m-%dT%H:%M:%S') as first_heartbeat,
 strftime(max(heartbeat_at) + to_seconds(90), '%Y-%m-%dT%H:%M:%S') as lease_expired_at, count(*) as heartbeats
from (select *, sum(fresh) over (partition by job_id order by heartbeat_at range between unbounded preceding and current row) as island
 from (select *, case when date_diff('second', lag(heartbeat_at) over (partition by job_id order by heartbeat_at), heartbeat_at) <= 90 then 0 else 1 end as fresh
 from heartbeats) x) y group by job_id, island"""


def iso_leases(df):
    return df.withColumns({c: iso_timestamp(F.col(c)) for c in ("first_heartbeat", "lease_expired_at")})


@query("lease_periods", LEASES)
def lease_periods(d):
    return iso_leases(jobs.lease_periods(d.heartbeats))


@query("job_transitions", """
select strftime(date_trunc('hour', changed_at), '%Y-%m-%dT%H:%M:%S') as window_start, status, count(*) as transitions
from changes group by 1, 2""")
def job_transitions(d):
    return jobs.job_transitions(d.changes).withColumn("window_start", iso_timestamp(F.col("window_start")))


@query("rolling_event_counts", """
select client, epoch_us(seen_at) as seen_us, count(*) as n, cast(any_value(recent) as bigint) as trailing_count
from (select client, seen_at, count(*) over (partition by client order by epoch_us(seen_at) range between 59999999 preceding and current row) as recent
 from requests) x group by client, seen_at""")
def rolling_event_counts(d):
    out = rates.rolling_event_counts(d.requests)
    return out.select("client", F.unix_micros("seen_at").alias("seen_us"), "n", "trailing_count")


# Every request with its decision, client by client in order of time and id.
WALK = """with recursive numbered as (select request_id, bucket, coalesce(client, 'unknown') as client, epoch_us(seen_at) as us, case bucket when 'auth' then 10 else 30 end as lim,
 row_number() over (partition by bucket, coalesce(client, 'unknown') order by seen_at, request_id) as rn from requests),
walk as (
 select request_id, bucket, client, us, rn, false as refused, [us] as kept from numbered where rn = 1
 union all
 select n.request_id, n.bucket, n.client, n.us, n.rn,
  len(list_filter(w.kept, lambda t: n.us - t < 60000000)) >= n.lim as refused,
  case when len(list_filter(w.kept, lambda t: n.us - t < 60000000)) >= n.lim then list_filter(w.kept, lambda t: n.us - t < 60000000)
   else list_append(list_filter(w.kept, lambda t: n.us - t < 60000000), n.us) end as kept
 from walk w join numbered n on n.bucket = w.bucket and n.client = w.client and n.rn = w.rn + 1)"""


@query("sliding_rate_violations", f"""{WALK}
select request_id, bucket, client, us as seen_us from walk where refused""")
def sliding_rate_violations(d):
    out = rates.sliding_rate_violations(d.requests)
    return out.select("request_id", "bucket", "client", F.unix_micros("seen_at").alias("seen_us"))
