"""Audit events: queries, and the rows that changes produce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docketlake.operators.documents import tenant_scope
from docketlake.operators.ordered import newest


def document_audit(events: DataFrame, document_id: int, n: int = 100) -> DataFrame:
    return newest(events.where(F.col("document_id") == document_id), "created_at", "audit_id").limit(n)


def audit_log(events: DataFrame, tenant_id: int | None, n: int = 200) -> DataFrame:
    return newest(tenant_scope(events, tenant_id), "created_at", "audit_id").limit(n)


def _event(rows: DataFrame, action: str, document: str, details, at: str, user: str | None = None) -> DataFrame:
    user_id = F.col(user) if user else F.lit(None)
    return rows.select(
        "tenant_id", user_id.cast("long").alias("user_id"), F.col(document).alias("document_id"),
        F.lit(action).alias("action"), details.alias("details"), F.col(at).alias("created_at"))


def audit_rows(
    changes: DataFrame | None = None, processed: DataFrame | None = None, recovered: DataFrame | None = None,
    redriven: DataFrame | None = None, linked: DataFrame | None = None, unlinked: DataFrame | None = None,
) -> DataFrame:
    """Audit rows of what happened, in one shape; whatever is given is told.

    ``changes``: tenant_id, user_id, doc_id, changes (JSON text), changed_at;
    ``processed``: tenant_id, document_id, job_id, attempts, finished_at;
    ``recovered``: jobs whose worker was lost (tenant_id, document_id, job_id, job_status, recovered_at);
    ``redriven``: the new jobs (tenant_id, document_id, job_id, parent_job_id, created_at);
    ``linked``, ``unlinked``: relationships that were made (as they are) and deleted
    (relationship_id, tenant_id, document_id, user_id, deleted_at).
    """
    told = []
    if changes is not None:
        told.append(_event(changes, "document.update", "doc_id", F.col("changes"), "changed_at", "user_id"))
    if processed is not None:
        done = F.to_json(F.struct("job_id", F.col("attempts").alias("attempt")))
        told.append(_event(processed, "document.processed", "document_id", done, "finished_at"))
    if recovered is not None:
        outcome = F.to_json(F.struct("job_id", F.col("job_status").alias("outcome"), F.lit("worker_lost").alias("reason")))
        told.append(_event(recovered, "job.recovered", "document_id", outcome, "recovered_at"))
    if redriven is not None:
        ids = F.to_json(F.struct("parent_job_id", "job_id"))
        told.append(_event(redriven, "job.redrive", "document_id", ids, "created_at"))
    if linked is not None:
        link = F.to_json(F.struct("relationship_id", "target_document_id", "relationship_type"))
        told.append(_event(linked, "document.relationship.create", "source_document_id", link, "created_at", "created_by_id"))
    if unlinked is not None:
        link = F.to_json(F.struct("relationship_id"))
        told.append(_event(unlinked, "document.relationship.delete", "document_id", link, "deleted_at", "user_id"))
    if not told:
        raise ValueError("nothing to tell")
    return reduce(DataFrame.unionByName, told)
