"""Queries on document, link, audit and registry rows."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from docketlake import fixed
from docketlake.functions.text import iso_date, iso_timestamp
from docketlake.operators import (
    audit, backfill, corrections, deadlines, documents, registry, relationships, search_index as searching,
)
from docketlake.operators import jobs as job_queries
from docketlake.plans.catalog import AS_OF, AS_OF_TIME, Data, iso, iso_days, number, query, scratch
from docketlake.session import compiled
from docketlake.sources import files, sinks, tables

DATES = ("effective_date", "expiration_date", "renewal_date", "review_date", "termination_date")
NEWEST = "order by created_at desc, doc_id desc"


def _short(df):
    return df.select("doc_id", "original_name", "status", "vendor", iso_timestamp(F.col("created_at")).alias("created_at"))


SHORT = f"doc_id, original_name, status, vendor, {iso('created_at')}"

# --- projections, filters, search -------------------------------------------


# view, key, a text and a further column of every stored table
LOADED = {
    "audit_events": ("audit", "audit_id", "action", "document_id"),
    "document_job_attempts": ("attempts", "attempt_number", "status", "started_at"),
    "document_jobs": ("jobs", "job_id", "queue_id", "heartbeat_at"),
    "document_relationships": ("edges", "relationship_id", "relationship_type", "target_document_id"),
    "documents": ("contracts", "doc_id", "text", "created_at"),
    "tenants": ("nation", "n_nationkey", "n_name", "n_name"),
    "users": ("customer", "c_custkey", "c_name", "c_name"),
}


@query("load_tables", " union all ".join(
    f"select '{name}' as table_name, count(*) as n, cast(sum({key}) as bigint) as keys,"
    f" cast(sum(length({text})) as bigint) as letters, count(distinct {other}) as others from {view}"
    for name, (view, key, text, other) in LOADED.items()))
def load_tables(d: Data):
    path = scratch(d.spark, "tables")
    sources = {
        "audit_events": d.audit, "document_job_attempts": d.attempts, "document_jobs": d.jobs,
        "document_relationships": d.edges, "documents": d.contracts,
        "tenants": d.table("nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name")),
        "users": d.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")),
    }
    for name, df in sources.items():
        known = tables.schema_of(name)
        df.select(*[F.col(c).cast(known[c].dataType).alias(c) for c in df.columns if c in known.names]).write.parquet(
            f"{path}/{name}"
        )
    loaded = tables.load_tables(d.spark, path)
    given = {"n_nationkey": "tenant_id", "n_name": "name", "c_custkey": "user_id", "c_name": "name"}
    sums = []
    for name, (_, *columns) in LOADED.items():
        key, text, other = (given.get(c, c) for c in columns)
        sums.append(loaded[name].agg(
            F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"), F.sum(F.length(text)).alias("letters"),
            F.count_distinct(other).alias("others")).select(F.lit(name).alias("table_name"), "*"))
    return functools.reduce(DataFrame.unionByName, sums)


@query("tenant_scope", f"select {SHORT} from contracts where tenant_id = 3")
def tenant_scope(d):
    return _short(documents.tenant_scope(d.contracts, 3))


@query("tenant_scope_without_tenant", f"select {SHORT} from contracts where tenant_id is null")
def tenant_scope_none(d):
    return _short(documents.tenant_scope(d.contracts, None))


VIEW = f"""doc_id, tenant_id, uploaded_by_id, reviewed_by_id, original_name, lower(status) as status, document_type,
 vendor, execution_status, {iso_days(*DATES)}, retention_category, generated_filename, processed_folder,
 storage_backend, source_storage_key, result_storage_key, file_size, checksum, lower(scan_status) as scan_status,
 scan_message, {iso('scanned_at')}, lower(review_status) as review_status, review_notes, {iso('reviewed_at')},
 error_message, {iso('created_at', 'updated_at')}"""


@query("document_view", f"select {VIEW} from contracts")
def document_view(d):
    return documents.document_view(d.contracts)


@query("document_detail", f"""
select {VIEW}, text as extracted_text,
 '{{' || concat_ws(',', '"document_type":"' || document_type || '"', '"execution_status":"' || execution_status || '"',
 '"vendor":"' || vendor || '"', '"retention_category":"' || retention_category || '"') || '}}' as metadata_json
from contracts where doc_id = 77""")
def document_detail(d):
    return documents.document_detail(d.contracts, 77)


@query("filter_documents", f"select {SHORT} from contracts where status = 'completed' and document_type = 'NDA' and vendor ilike '%00012%'")
def filter_documents(d):
    return _short(documents.filter_documents(d.contracts, "completed", "NDA", "00012"))


@query("search_documents", f"""
select {SHORT} from contracts where original_name ilike '%work_between%' or vendor ilike '%work_between%' or text ilike '%work_between%'""")
def search_documents(d):
    return _short(documents.search_documents(d.contracts, "work_between"))


@query("search_texts", """
select doc_id, lang, source from documents where source ilike '%license%' or lang ilike '%license%' or text ilike '%license%'""")
def search_texts(d):
    raw = d.table("documents").select(
        "doc_id", "lang", "source", "text", F.col("source").alias("original_name"), F.col("lang").alias("vendor")
    )
    return documents.search_documents(raw, "license").select("doc_id", "lang", "source")


# One common word, one wildcard, a phrase, a pattern whose pieces stand apart, and one too short for a trigram.
SEARCHES = ("license", "l_cense", "of the", "copy%right", "zq")


@query("search_index", f"""
select {SHORT} from contracts where original_name ilike '%work_between%' or vendor ilike '%work_between%' or text ilike '%work_between%'""")
def search_index(d):
    path = scratch(d.spark, "search")
    kept = d.contracts.select("doc_id", "original_name", "status", "vendor", "created_at", "text")
    searching.write_index(kept, path)
    return _short(searching.search_index(d.spark, path, "work_between"))


@query("search_index_texts", " union all ".join(
    f"select '{q}' as query, doc_id, lang, source from documents where source ilike '%{q}%' or lang ilike '%{q}%' or text ilike '%{q}%'"
    for q in SEARCHES))
def search_index_texts(d):
    """Several searches over one index of all documents."""
    path = scratch(d.spark, "search")
    searching.write_index(d.table("documents").select(
        "doc_id", "lang", "source", "text", F.col("source").alias("original_name"), F.col("lang").alias("vendor")), path)
    found = [searching.search_index(d.spark, path, q).select(F.lit(q).alias("query"), "doc_id", "lang", "source") for q in SEARCHES]
    return functools.reduce(DataFrame.unionByName, found)


@query("list_documents", f"select {SHORT} from (select * from contracts where document_type = 'MSA' {NEWEST} limit 20 offset 20) x")
def list_documents(d):
    return _short(documents.list_documents(documents.filter_documents(d.contracts, document_type="MSA"), page=2))


@query("list_documents_after", f"""
select {SHORT} from (select * from contracts where created_at < timestamp '1998-06-01 00:00:00'
 or (created_at = timestamp '1998-06-01 00:00:00' and doc_id < 500) {NEWEST} limit 20) x""")
def list_documents_after(d):
    from datetime import datetime

    return _short(documents.list_documents(d.contracts, after=(datetime(1998, 6, 1), 500)))


@query("page_info", """
select count(*) as total, 1 as page, 20 as per_page, cast(ceil(count(*) / 20.0) as bigint) as pages
from contracts where document_type = 'MSA'""")
def page_info(d):
    return documents.page_info(documents.filter_documents(d.contracts, document_type="MSA"))


@query("review_queue", f"select {SHORT} from (select * from contracts where review_status = 'needs_review' {NEWEST} limit 20) x")
def review_queue(d):
    return _short(documents.review_queue(d.contracts))


@query("recent_documents", f"select {SHORT} from (select * from contracts {NEWEST} limit 5) x")
def recent_documents(d):
    return _short(documents.recent_documents(d.contracts))


@query("export_documents", f"""
select doc_id, original_name, document_type, vendor, execution_status, {iso_days('effective_date', 'expiration_date')},
 retention_category, lower(review_status) as review_status, {iso('created_at')}
from contracts where status = 'completed' and (original_name ilike '%NDA%' or vendor ilike '%NDA%' or text ilike '%NDA%')""")
def export_documents(d):
    return documents.export_documents(d.contracts, status="completed", search="NDA")


@query("write_export", """
select doc_id, original_name, coalesce(document_type, '') as document_type, strftime(expiration_date, '%Y-%m-%d') as expiration_date
from contracts where status = 'failed'""")
def write_export(d):
    path = scratch(d.spark, "export")
    sinks.write_csv(documents.export_documents(d.contracts, status="failed"), path)
    back = d.spark.read.csv(path, header=True)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "original_name",
                       F.coalesce("document_type", F.lit("")).alias("document_type"), "expiration_date")


# --- statistics ----------------------------------------------------------------


@query("document_stats", """
select 'total' as dimension, 'all' as value, count(*) as documents from contracts union all
select 'status', status, count(*) from contracts group by status union all
select 'document_type', document_type, count(*) from contracts where document_type is not null group by document_type union all
select 'execution_status', execution_status, count(*) from contracts where execution_status is not null group by execution_status union all
select 'review_status', review_status, count(*) from contracts group by review_status""")
def document_stats(d):
    return documents.document_stats(d.contracts)


@query("dashboard_tiles", """
select count(*) as total, count(*) filter (where status = 'completed') as completed,
 count(*) filter (where review_status = 'needs_review') as needs_review, count(*) filter (where status = 'failed') as failed
from contracts""")
def dashboard_tiles(d):
    return documents.dashboard_tiles(d.contracts)


def _with_error(df):
    return df.withColumn("error", F.col("error_message"))


@query("processing_summary", """
select count(*) filter (where error_message is null) as successful, count(*) filter (where error_message is not null) as errors,
 count(*) as total,
 count(*) filter (where error_message is null and execution_status = 'final') as final_documents,
 count(*) filter (where error_message is null and execution_status = 'supporting') as supporting_documents,
 count(*) filter (where error_message is null and execution_status is null) as other_documents,
 round(100.0 * count(*) filter (where error_message is null and execution_status = 'final') / cast(count(*) filter (where error_message is null) as double), 1) as final_percent
from contracts""")
def processing_summary(d):
    return documents.processing_summary(_with_error(d.contracts))


@query("error_records", """
select path as original_path, error_message as reason from contracts where error_message is not null""")
def error_records(d):
    return documents.error_records(_with_error(d.contracts))


# --- deadlines, expiry, registry --------------------------------------------------


@query("deadlines", f"""
select {VIEW}, kind, strftime(due_date, '%Y-%m-%d') as due_date,
 cast(date_diff('day', date '1999-01-01', due_date) as bigint) as days_remaining, due_date < date '1999-01-01' as overdue,
 case when due_date < date '1999-01-01' then 'overdue' when date_diff('day', date '1999-01-01', due_date) <= 30 then 'soon' else 'later' end as urgency
from (select *, 'expiration' as kind, expiration_date as due_date from contracts union all
 select *, 'renewal', renewal_date from contracts union all
 select *, 'review', review_date from contracts union all
 select *, 'termination', termination_date from contracts) x
where due_date <= date '1999-01-01' + 90""")
def deadline_list(d):
    return number(deadlines.deadlines(d.contracts, AS_OF, 90), "days_remaining").withColumn(
        "due_date", iso_date(F.col("due_date"))
    )


TRACKED = "tracking_id, vendor, document_type, filename, expiration_date, renewal_date, review_date, retention_category"
EXPIRES = "try_cast(expiration_date as timestamp)"
LEFT = f"cast(floor(date_diff('second', timestamp '1999-01-01 00:00:00', {EXPIRES}) / 86400.0) as bigint)"


@query("expiring_documents", f"""
select {TRACKED}, {LEFT} as days_until_expiration from tracked
where {EXPIRES} between timestamp '1999-01-01 00:00:00' and timestamp '1999-01-01 00:00:00' + interval 372 days""")
def expiring_documents(d):
    return deadlines.expiring_documents(d.tracked, AS_OF_TIME)


@query("expiring_next_year", f"select {TRACKED}, {LEFT} as days_until_expiration from tracked where {LEFT} between 0 and 365")
def expiring_next_year(d):
    return deadlines.expiring_next_year(d.tracked, AS_OF_TIME)


@query("expiry_report", f"""
select {TRACKED}, {LEFT} as days_until_expiration,
 case when {EXPIRES} is null then 'no_expiration' when {EXPIRES} < timestamp '1999-01-01 00:00:00' then 'expired'
 when {EXPIRES} <= timestamp '1999-01-01 00:00:00' + interval 90 days then 'expiring_soon' else 'active' end as expiration_status
from tracked""")
def expiry_report(d):
    return deadlines.expiry_report(d.tracked, AS_OF_TIME)


@query("expiry_status", f"""
select case when {EXPIRES} is null then 'no_expiration' when {EXPIRES} < timestamp '1999-01-01 00:00:00' then 'expired'
 when {EXPIRES} <= timestamp '1999-01-01 00:00:00' + interval 90 days then 'expiring_soon' else 'active' end as expiration_status,
 count(*) as documents from tracked group by 1""")
def expiry_status(d):
    report = deadlines.expiry_report(d.tracked, AS_OF_TIME)
    return report.groupBy("expiration_status").agg(F.count(F.lit(1)).alias("documents"))


@query("read_registry", "select tracking_id, vendor, filename, expiration_date, retention_category from tracked where expiration_date is not null")
def read_registry(d):
    """Registry files of at most a thousand documents each, written and read back."""
    listed = d.tracked.where("expiration_date is not null").withColumn(
        "registry", F.floor(F.regexp_extract("tracking_id", r"(\d+)$", 1).cast("long") / 1000)
    )
    entry = F.struct("tracking_id", "vendor", "document_type", "filename", "expiration_date", "retention_category")
    registries = listed.groupBy("registry").agg(F.collect_list(entry).alias("expiration_tracking"))
    path = scratch(d.spark, "registries")
    registries.select(
        "registry", F.to_json(F.struct(F.size("expiration_tracking").alias("total_documents"), "expiration_tracking")).alias("value")
    ).write.partitionBy("registry").text(path)
    return files.read_registry(d.spark, path).select(
        "tracking_id", "vendor", "filename", "expiration_date", "retention_category"
    )


@query("by_retention_category", f"select {TRACKED} from tracked where lower(retention_category) = 'short_term'")
def by_retention_category(d):
    return deadlines.by_retention_category(d.tracked, "Short_Term")


@query("retention_counts", """
select coalesce(retention_category, 'unknown') as retention_category, count(*) as documents from tracked group by 1""")
def retention_counts(d):
    return deadlines.retention_counts(d.tracked)


@query("registry_totals", "select count(*) as total_documents, count(expiration_date) as documents_with_expiration from tracked")
def registry_totals(d):
    return registry.registry_totals(d.tracked)


@query("registry_rollup", """
select coalesce(retention_category, 'unknown') as retention_category, count(*) as documents,
 count(expiration_date) as documents_with_expiration from tracked group by 1""")
def registry_rollup(d):
    return registry.registry_rollup(d.tracked)


@query("write_registry", "select tracking_id, expiration_date, vendor from tracked where expiration_date is not null")
def write_registry(d):
    path = scratch(d.spark, "registry")
    sinks.write_registry(d.tracked, path)
    return d.spark.read.schema("tracking_id string, expiration_date string, vendor string").json(
        f"{path}/expiration_tracking"
    )


# --- links ----------------------------------------------------------------------------

RELATED = """
select l.relationship_id, l.relationship_type, l.tenant_id, strftime(l.created_at, '%Y-%m-%dT%H:%M:%S') as created_at, l.direction,
 l.document_id, l.related_id, l.created_by_id, c.original_name, c.document_type, c.status
from (select *, 'outgoing' as direction, source_document_id as document_id, target_document_id as related_id from edges union all
 select *, 'incoming', target_document_id, source_document_id from edges where source_document_id <> target_document_id) l
join contracts c on c.doc_id = l.related_id and c.tenant_id is not distinct from l.tenant_id"""


def _iso_created(df):
    return df.withColumn("created_at", iso_timestamp(F.col("created_at")))


@query("related_documents", RELATED)
def related_documents(d):
    return _iso_created(relationships.related_documents(d.edges, d.contracts))


# A document that many links lead to at every scale.
LINKED = "(select target_document_id from edges e join contracts c on c.doc_id = e.target_document_id and c.tenant_id is not distinct from e.tenant_id group by 1 order by count(*) desc, 1 limit 1)"


@query("related_documents_of", f"""
select r.*, {', '.join(f'v.{c} as related_{c}' for c in documents.VIEW_FIELDS)}
from ({RELATED} where l.document_id = {LINKED}) r join (select {VIEW} from contracts) v on v.doc_id = r.related_id""")
def related_documents_of(d):
    tenants = d.contracts.select(F.col("tenant_id").alias("owner"), F.col("doc_id").alias("target_document_id"))
    seen = d.edges.join(tenants, "target_document_id").where(F.col("tenant_id").eqNullSafe(F.col("owner")))
    most = seen.groupBy("target_document_id").count().orderBy(F.col("count").desc(), "target_document_id").first()
    found = _iso_created(relationships.related_documents(d.edges, d.contracts, most["target_document_id"]))
    return found.select("*", *[F.col(f"related_document.{c}").alias(f"related_{c}") for c in documents.VIEW_FIELDS]).drop("related_document")


KINDS = ", ".join(f"'{k}'" for k in fixed.RELATIONSHIP_TYPES)


@query("relationship_violations", f"""
select relationship_id, 'self_link' as violation from edges where source_document_id = target_document_id union all
select relationship_id, 'invalid_type' from edges where relationship_type not in ({KINDS}) union all
select relationship_id, 'target_not_found' from edges e where not exists (select 1 from contracts c
 where c.doc_id = e.target_document_id and c.tenant_id is not distinct from e.tenant_id) union all
select relationship_id, 'duplicate_pair' from (select relationship_id, row_number() over (
 partition by source_document_id, target_document_id order by relationship_id) as rn from edges) x where rn > 1""")
def relationship_violations(d):
    return relationships.relationship_violations(d.edges, d.contracts)


@query("cascade_edges", """
select relationship_id, source_document_id, target_document_id from edges
where source_document_id in (select doc_id from contracts where status <> 'failed')
and target_document_id in (select doc_id from contracts where status <> 'failed')""")
def cascade_edges(d):
    left = d.contracts.where("status <> 'failed'")
    return relationships.cascade_edges(d.edges, left).select(
        "relationship_id", "source_document_id", "target_document_id"
    )


# --- audit ------------------------------------------------------------------------------

AUDIT = "audit_id, tenant_id, user_id, document_id, action, details"


@query("document_audit", f"select {AUDIT} from (select * from audit where document_id = 12 order by created_at desc, audit_id desc limit 100) x")
def document_audit(d):
    return audit.document_audit(d.audit, 12).drop("created_at")


@query("audit_log", f"select {AUDIT} from (select * from audit where tenant_id = 2 order by created_at desc, audit_id desc limit 200) x")
def audit_log(d):
    return audit.audit_log(d.audit, 2).drop("created_at")


# --- corrections and data quality ----------------------------------------------------------

FIELDS = ("document_type", "execution_status", "retention_category", "vendor", "review_notes",
          *DATES, "mark_reviewed")


def patches(d: Data):
    """Correction rows with their fields as a map (absent fields are left out)."""
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"p_{f}").alias("value")) for f in FIELDS])
    return d.patch_columns.select(
        F.col("doc_id").cast("long").alias("doc_id"), "seq", F.col("reviewer_id").cast("long").alias("reviewer_id"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"),
    )


def _in(values, upper=""):
    return ", ".join(f"'{v}'" for v in ("",) + tuple(values))


def _after(field: str) -> str:
    """State of a field after a correction (SQL)."""
    given = {"document_type": "nullif(upper(p_document_type), '')", "execution_status": "nullif(lower(p_execution_status), '')",
             "retention_category": "nullif(lower(p_retention_category), '')", "vendor": "nullif(trim(p_vendor), '')",
             "review_notes": "p_review_notes"}.get(field, f"try_cast(nullif(p_{field}, '') as date)")
    return f"case when p_{field} is null then {field} else {given} end"


AFTER = {f: _after(f) for f in FIELDS if f != "mark_reviewed"} | {
    "review_status": "case when p_mark_reviewed = 'true' then 'reviewed' else review_status end",
    "reviewed_by_id": "case when p_mark_reviewed = 'true' then reviewer_id else reviewed_by_id end"}
ALSO_OLD = ", ".join(f"{f}, {f} as old_{f}" for f in AFTER)
NOT_ISO = " ".join(
    f"when p_{f} <> '' and not regexp_matches(p_{f}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then '{f} must be YYYY-MM-DD'" for f in DATES)
CHECKED = f"""
with recursive placed as (select *, row_number() over (partition by doc_id order by seq, reviewer_id) as place,
 case when upper(p_document_type) not in ({_in(fixed.DOCUMENT_TYPES)}) then 'Invalid document_type'
 when lower(p_execution_status) not in ({_in(fixed.EXECUTION_STATUSES)}) then 'Invalid execution_status'
 when lower(p_retention_category) not in ({_in(fixed.RETENTION_CATEGORIES)}) then 'Invalid retention_category'
 when length(p_review_notes) > 4000 then 'review_notes is too long' {NOT_ISO} end as fault from patch_columns),
step as (select doc_id, tenant_id, cast(0 as bigint) as place, cast(null as varchar) as error, {ALSO_OLD} from contracts
 union all
 select doc_id, tenant_id, place, problem, {", ".join(f"case when problem is null then {new} else {f} end, {f}" for f, new in AFTER.items())}
 from (select s.* exclude (place, error), p.* exclude (doc_id), coalesce(p.fault, case when {AFTER['expiration_date']} < {AFTER['effective_date']}
  then 'expiration_date cannot be before effective_date' end) as problem
  from step s join placed p on p.doc_id = s.doc_id and p.place = s.place + 1) x),
checked as (select p.*, s.* exclude (doc_id, place, error),
 case when s.doc_id is null then 'Document not found' else s.error end as error
 from placed p left join step s on s.doc_id = p.doc_id and s.place = p.place)
"""


@query("rejected_corrections", CHECKED + "select doc_id, cast(seq as bigint) as seq, error from checked where error is not null")
def rejected_corrections(d):
    return number(corrections.rejected_corrections(corrections.checked_corrections(d.contracts, patches(d))), "seq")


def _change(field):
    return f"""select doc_id, tenant_id, reviewer_id, '{field}' as field, cast(old_{field} as varchar) as old_value, cast({field} as varchar) as new_value
from checked where error is null and p_{field} is not null"""


@query("correction_changes", CHECKED + " union all ".join([
    *[_change(f) for f in FIELDS if f != "mark_reviewed"],
    "select doc_id, tenant_id, reviewer_id, 'review_status', old_review_status, 'reviewed' from checked where error is null and p_mark_reviewed = 'true'",
]))
def correction_changes(d):
    compiled(d.spark)
    return corrections.correction_changes(corrections.checked_corrections(d.contracts, patches(d)))


@query("apply_corrections", CHECKED + f"""
select doc_id, document_type, execution_status, retention_category, vendor, review_notes, {iso_days(*DATES)}, review_status, reviewed_by_id
from step qualify row_number() over (partition by doc_id order by place desc) = 1""")
def apply_corrections(d):
    compiled(d.spark)
    docs = d.contracts
    checked = corrections.checked_corrections(docs, patches(d))
    return corrections.apply_corrections(docs, checked, AS_OF_TIME).select(
        "doc_id", *[f for f in FIELDS if f not in (*DATES, "mark_reviewed")],
        *[iso_date(F.col(f)).alias(f) for f in DATES], "review_status", "reviewed_by_id",
    )


AUDITED_AT = datetime(1998, 1, 1)


@query("audit_rows", CHECKED + """,
told as (
select tenant_id, reviewer_id as user_id, doc_id as document_id, 'document.update' as action, null as details from checked where error is null
union all select tenant_id, null, document_id, 'document.processed', printf('{"job_id":%d,"attempt":%d}', job_id, attempts) from jobs where status = 'completed'
union all select tenant_id, null, document_id, 'job.recovered', printf('{"job_id":%d,"outcome":"%s","reason":"worker_lost"}', job_id,
 case when attempts >= max_attempts then 'failed' else 'pending' end) from jobs
 where status = 'processing' and (heartbeat_at is null or heartbeat_at < timestamp '1998-01-01 00:00:00' - interval 90 seconds)
union all select tenant_id, null, document_id, 'job.redrive', printf('{"parent_job_id":%d,"job_id":%d}', parent_job_id, job_id) from jobs where parent_job_id is not null
union all select tenant_id, created_by_id, source_document_id, 'document.relationship.create',
 printf('{"relationship_id":%d,"target_document_id":%d,"relationship_type":"%s"}', relationship_id, target_document_id, relationship_type) from edges
union all select tenant_id, 3, target_document_id, 'document.relationship.delete', printf('{"relationship_id":%d}', relationship_id) from edges where relationship_type = 'copy')
select tenant_id, cast(user_id as bigint) as user_id, document_id, action, details from told""")
def audit_rows(d):
    log = corrections.change_log(corrections.checked_corrections(d.contracts, patches(d)), AS_OF_TIME)
    lost = job_queries.stale_leases(d.jobs, d.attempts, AUDITED_AT).withColumn("recovered_at", F.lit(AUDITED_AT))
    gone = d.edges.where("relationship_type = 'copy'").select(
        "relationship_id", "tenant_id", F.col("target_document_id").alias("document_id"), F.lit(3).alias("user_id"),
        F.lit(AUDITED_AT).alias("deleted_at"))
    told = audit.audit_rows(
        log, d.jobs.where("status = 'completed'"), lost, d.jobs.where("parent_job_id is not null"), d.edges, gone)
    # what a correction changes is compared by correction_changes
    details = F.when(F.col("action") != "document.update", F.col("details"))
    return told.select("tenant_id", "user_id", "document_id", "action", details.alias("details"))


def _rule(message, broken):
    return f"select doc_id, '{message}' as violation from contracts where {broken}"


@query("document_violations", " union all ".join([
    _rule("Invalid document_type", f"document_type not in ({_in(fixed.DOCUMENT_TYPES)})"),
    _rule("Invalid execution_status", f"execution_status not in ({_in(fixed.EXECUTION_STATUSES)})"),
    _rule("Invalid retention_category", f"retention_category not in ({_in(fixed.RETENTION_CATEGORIES)})"),
    _rule("review_notes is too long", "length(review_notes) > 4000"),
    _rule("expiration_date cannot be before effective_date", "expiration_date < effective_date"),
]))
def document_violations(d):
    return documents.document_violations(d.contracts)


@query("backfill_storage_keys", """
select doc_id, coalesce(storage_key, stored_path) as source_storage_key,
 case when status = 'completed' then coalesce(storage_key, stored_path) end as result_storage_key from contracts""")
def backfill_storage_keys(d):
    return backfill.backfill_storage_keys(d.contracts).select("doc_id", "source_storage_key", "result_storage_key")


@query("rewrite_job_ids", """
select job_id, case when starts_with(queue_id, 'document-job:') then replace(queue_id, 'document-job:', 'document-job-') else queue_id end as queue_id from jobs""")
def rewrite_job_ids(d):
    return backfill.rewrite_job_ids(d.jobs).select("job_id", "queue_id")
