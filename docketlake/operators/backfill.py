"""One-off rewrites of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def backfill_storage_keys(docs: DataFrame) -> DataFrame:
    """Source key from key or path; a result key only for completed documents."""
    key = F.coalesce("storage_key", "stored_path")
    return docs.withColumns({
        "source_storage_key": key,
        "result_storage_key": F.when(F.lower("status") == "completed", key),
    })


def rewrite_job_ids(jobs: DataFrame) -> DataFrame:
    """Queue ids with a colon become ids with a dash."""
    old = F.col("queue_id")
    new = F.replace(old, F.lit("document-job:"), F.lit("document-job-"))
    return jobs.withColumn("queue_id", F.when(old.startswith("document-job:"), new).otherwise(old))
