"""Streaming jobs run over what the given tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions.text import iso_timestamp
from docketlake.operators.intake import analyze_documents
from docketlake.plans.catalog import Data, number, query, scratch
from docketlake.plans.queries_jobs import LEASES, WALK, iso_leases
from docketlake.plans.queries_text import ALL_LABELS, _clean
from docketlake.sources.sinks import read_published
from docketlake.streaming import jobs as streams


def _stream(d: Data, df, name: str):
    """The rows of ``df`` as a file stream in one folder."""
    path = scratch(d.spark, name)
    df.write.parquet(path)
    return d.spark.readStream.schema(df.schema).parquet(path)


def _run(d: Data, stream, name: str):
    return streams.run_to_files(stream, scratch(d.spark, name), scratch(d.spark, f"{name}-state"))


@query("stream_intake", f"""with {ALL_LABELS}
select c.doc_id, 'results/' || cast(c.doc_id as varchar) || '/' || c.original_name as location, l.doc_type as document_type,
 {_clean('l.vendor')} as clean_vendor, cast(2 as bigint) as version
from contracts c join labels_made l on l.doc_id = c.doc_id""")
def stream_intake(d):
    """A stream publishes an old version of every document; one that starts afresh gets two versions of each, the older one last."""
    docs = d.wide.contracts.select(
        "doc_id", "path", "folder", "original_name", "text", F.col("created_at").alias("arrived_at")
    )
    older = docs.withColumns({"text": F.lit("Amendment"), "folder": F.lit("contracts"),
                              "arrived_at": F.col("arrived_at") - F.expr("interval 1 hour")})
    path = scratch(d.spark, "published")
    for arrivals in (older, docs.unionByName(older)):
        done = streams.stream_intake(
            _stream(d, arrivals, "arrivals"), path, scratch(d.spark, "intake-state"), analyze_documents)
        done.awaitTermination()
    return read_published(d.spark, path).select("doc_id", "location", "document_type", "clean_vendor", "version")


@query("job_transitions_stream", """
select strftime(date_trunc('hour', changed_at), '%Y-%m-%dT%H:%M:%S') as window_start, status, count(*) as transitions
from changes group by date_trunc('hour', changed_at), status
having date_trunc('hour', changed_at) + interval 1 hour <= (select max(changed_at) from changes) - interval 10 minutes""")
def job_transitions_stream(d):
    closed = streams.job_transitions_stream(_stream(d, d.changes, "changes"))
    return _run(d, closed, "transitions").withColumn("window_start", iso_timestamp(F.col("window_start")))


@query("lease_expiry_stream", f"""select * from ({LEASES}) l
where strptime(lease_expired_at, '%Y-%m-%dT%H:%M:%S') <= (select max(heartbeat_at) from heartbeats) - interval 1 minute""")
def lease_expiry_stream(d):
    expired = streams.lease_expiry_stream(_stream(d, d.heartbeats, "heartbeats"))
    return iso_leases(_run(d, expired, "leases"))


@query("sliding_rate_stream", f"""{WALK}
select request_id, bucket, coalesce(client, 'unknown') as client, us as seen_us from walk where refused
and us <= (select epoch_us(max(seen_at)) from requests) - 60000000""")
def sliding_rate_stream(d):
    """Requests arrive in an order that has nothing to do with their time; those the watermark has passed are decided."""
    shuffled = d.requests.orderBy(F.xxhash64("request_id"))
    refused = streams.sliding_rate_stream(_stream(d, shuffled, "requests"))
    return number(_run(d, refused, "refused"), "request_id").select(
        "request_id", "bucket", "client", F.unix_micros("seen_at").alias("seen_us"))
