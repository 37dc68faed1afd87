"""Document, job and event tables derived from the given Parquet tables.

Every view is one SQL text for Spark and for the checking database; the few
functions that differ are written through a dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.sources.tables import spread

BASE_TABLES = ("customer", "orders", "lineitem", "events", "documents")


class SparkDialect:
    text = "string"

    def add_days(self, day, n):
        return f"date_add({day}, cast({n} as int))"

    def add_seconds(self, ts, n):
        return f"timestampadd(second, cast({n} as int), {ts})"

    def long_date(self, d):
        return f"date_format({d}, 'MMMM d, yyyy')"

    def us_date(self, d):
        return f"date_format({d}, 'M/d/yyyy')"

    def iso_date(self, d):
        return f"date_format({d}, 'yyyy-MM-dd')"

    def micros(self, ts):
        return f"unix_micros(cast({ts} as timestamp))"

    def from_micros(self, us):
        return f"timestamp_micros({us})"

    def whole(self, a, b):
        return f"({a} div {b})"

    def numbers(self, n):
        return f"explode(sequence(1, cast({n} as int)))"

    def lines(self, text):
        return f"posexplode(split({text}, '\\n')) as (position, line)"

    def binary(self, text):
        return f"cast({text} as binary)"


class CheckDialect:
    text = "varchar"

    def add_days(self, day, n):
        return f"({day} + cast({n} as integer))"

    def add_seconds(self, ts, n):
        return f"({ts} + to_seconds(cast({n} as integer)))"

    def long_date(self, d):
        return f"strftime({d}, '%B %-d, %Y')"

    def us_date(self, d):
        return f"strftime({d}, '%-m/%-d/%Y')"

    def iso_date(self, d):
        return f"strftime({d}, '%Y-%m-%d')"

    def micros(self, ts):
        return f"epoch_us({ts})"

    def from_micros(self, us):
        return f"make_timestamp({us})"

    def whole(self, a, b):
        return f"({a} // {b})"

    def numbers(self, n):
        return f"unnest(range(1, cast({n} as bigint) + 1))"

    def lines(self, text):
        return (
            f"unnest(range(0, len(string_split({text}, chr(10))))) as position, "
            f"unnest(string_split({text}, chr(10))) as line"
        )

    def binary(self, text):
        return f"encode({text})"


def _contracts(d) -> str:
    day = "cast(o_orderdate as date)"
    expires = d.add_days(day, "365 * (1 + o_orderkey % 5)")
    form_day = f"cast(1 + o_orderkey % 31 as {d.text})"
    form_year = f"cast(1988 + o_orderkey % 50 as {d.text})"
    return f"""
select k.*,
 '/intake/' || folder || '/' || cast(doc_id as {d.text}) || '/' || original_name as path,
 case document_type when 'MSA' then case when expiration_date is null then 'indefinite' else 'long_term' end
  when 'NDA' then 'indefinite' when 'LICENSE' then 'indefinite' when 'PO' then 'short_term'
  when 'AMD' then 'tied_to_parent' when 'SOW' then 'contracts' end as retention_category,
 case when status = 'completed' then 'AGMT_' || cast(doc_id as {d.text}) || '.pdf' end as generated_filename,
 case when status = 'completed' then execution_status end as processed_folder,
 'uploads/' || cast(doc_id as {d.text}) as stored_path,
 case when doc_id % 3 = 0 then 'keys/' || cast(doc_id as {d.text}) end as storage_key,
 'uploads/' || cast(doc_id as {d.text}) as source_storage_key,
 case when status = 'completed' and doc_id % 9 <> 0 then 'results/' || cast(doc_id as {d.text}) end as result_storage_key
from (
select o_orderkey as doc_id,
 case when c_nationkey % 7 = 0 then null else c_nationkey % 5 end as tenant_id,
 o_custkey % 50 as uploaded_by_id,
 case when o_orderkey % 6 = 1 then o_custkey % 20 end as reviewed_by_id,
 replace(c_name,'#',' ') || case o_orderkey % 4 when 0 then ' LLC' when 1 then ' Inc.' when 2 then ' Corporation' else ' Ltd.' end as vendor,
 replace(c_name,'#','') || '_' || case o_orderkey % 7 when 0 then 'MSA' when 1 then 'SOW' when 2 then 'NDA' when 3 then 'PO' when 4 then 'AMD' when 5 then 'LICENSE' else 'CONTRACT' end || case o_orderkey % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.txt' else '.doc' end as original_name,
 case o_orderkey % 9 when 0 then 'contracts' when 1 then '' when 2 then '123e4567-e89b-12d3-a456-426614174000' when 3 then 'Archive' when 4 then 'Contracts-Agreements' else replace(c_name,'#',' ') || ' Contracts' end as folder,
 case when o_orderkey % 97 = 0 then 'MEMO' else case o_orderkey % 8 when 0 then null when 1 then 'MSA' when 2 then 'SOW' when 3 then 'NDA' when 4 then 'PO' when 5 then 'AMD' when 6 then 'LICENSE' else 'CONTRACT' end end as document_type,
 case when o_orderkey % 8 = 0 then null when o_orderkey % 2 = 1 then 'final' else 'supporting' end as execution_status,
 case when o_orderkey % 13 = 0 then 'processing' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'pending' else 'failed' end as status,
 case when o_orderstatus = 'P' then 'Document content could not be processed' end as error_message,
 case o_orderkey % 6 when 0 then 'needs_review' when 1 then 'reviewed' else 'not_required' end as review_status,
 case when o_orderkey % 101 = 0 then repeat('x', 4001) when o_orderkey % 6 = 1 then 'checked' end as review_notes,
 case when o_orderkey % 6 = 1 then {d.add_seconds('cast(o_orderdate as timestamp)', 'o_orderkey % 86400')} end as reviewed_at,
 case when o_orderkey % 50 = 0 then 'infected' else 'clean' end as scan_status,
 'scanned' as scan_message,
 cast(o_orderdate as timestamp) as scanned_at,
 'local' as storage_backend,
 (o_orderkey * 7919) % 5000000 as file_size,
 cast(null as {d.text}) as checksum,
 {day} as effective_date,
 case when o_orderkey % 3 = 0 then null when o_orderkey % 89 = 1 then {d.add_days(day, '-30')} else {expires} end as expiration_date,
 case when o_orderkey % 4 = 0 then {d.add_days(day, '335')} end as renewal_date,
 case when o_orderkey % 5 = 0 then {d.add_days(day, '180')} end as review_date,
 case when o_orderkey % 11 = 0 then {d.add_days(day, '400')} end as termination_date,
 cast(o_orderdate as timestamp) as created_at,
 {d.add_seconds('cast(o_orderdate as timestamp)', 'o_orderkey % 1000')} as updated_at,
 case when o_orderkey % 29 = 0 then '' else
 case o_orderkey % 7 when 0 then 'Master Service Agreement' when 1 then 'Statement of Work' when 2 then 'Non-Disclosure Agreement' when 3 then 'Purchase Order' when 4 then 'Amendment' when 5 then 'License Agreement' else 'General Terms' end
  || ' between Example Holdings and ' || replace(c_name,'#',' ') || ' (the Vendor).' || chr(10) || 'Effective as of ' || {d.long_date('o_orderdate')} || '.' || chr(10)
  || case o_orderkey % 3 when 0 then '' else 'This agreement expires on ' || {d.us_date(expires)} || '.' || chr(10) end
  || case o_orderkey % 4 when 0 then 'It automatically renews on ' || {d.iso_date(d.add_days(day, '335'))} || '.' || chr(10) else '' end
  || case o_orderkey % 5 when 0 then 'Subject to review on ' || {d.long_date(d.add_days(day, '180'))} || ';' || chr(10) else '' end
  || case o_orderkey % 11 when 0 then 'The termination date is ' || {d.us_date(d.add_days(day, '400'))} || '.' || chr(10) else '' end
  || case o_orderkey % 13 when 0 then 'Expiration date: ' || {form_day} || 'th day of March, ' || {form_year} || chr(10)
   when 1 then 'Renewal date: ' || {form_day} || ' June ' || {form_year} || chr(10) when 2 then 'The termination date is Sept ' || {form_day} || ', ' || {form_year} || chr(10)
   when 3 then 'Effective date: October ' || {form_day} || 'rd, ' || {form_year} || chr(10) when 4 then 'The termination date is 12/' || {form_day} || '/' || substr({form_year}, 3, 2) || chr(10)
   when 5 then 'Renewal date: ' || {form_day} || ' Sept ' || {form_year} || chr(10) when 6 then 'Effective date: Feb. ' || {form_day} || ' ' || {form_year} || chr(10)
   when 7 then 'Expiration date: March ' || {form_year} || chr(10) when 8 then 'Signed 5.' || {form_day} || '.' || {form_year} || chr(10)
   when 9 then 'Signed ' || {form_year} || '.03.' || {form_day} || chr(10) when 10 then 'Renewal date: Mar-' || {form_day} || '-' || {form_year} || chr(10)
   when 11 then 'The termination date is ' || {form_day} || '-Mar-' || {form_year} || chr(10) when 12 then 'Signed ' || {form_day} || '/3/' || {form_year} || chr(10) else '' end
  || case o_orderkey % 4 when 0 then 'Digitally signed by Jane Doe' when 1 then 'DocuSign Envelope ID: 12345' when 2 then 'By: ________ Date: ________' else 'Draft for discussion' end
  || case o_orderkey % 10 when 0 then chr(10) || 'Witnessed by: John Roe' || chr(10) || 'Notary Public' when 1 then chr(10) || 'In witness whereof the parties have executed this agreement' when 2 then chr(10) || 'Name: Ann Poe Title: Director Date: May 1 ' else '' end
 end as text
from orders join customer on o_custkey = c_custkey) k"""


def _jobs(d) -> str:
    at = "cast(o_orderdate as timestamp)"
    return f"""
select o_orderkey as job_id, o_orderkey as document_id,
 case when o_custkey % 7 = 0 then null else o_custkey % 5 end as tenant_id,
 case when o_orderkey % 13 = 0 then 'processing' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'queued' else 'failed' end as status,
 cast(1 + o_orderkey % 3 as int) as attempts, 3 as max_attempts,
 case when o_orderkey % 10 = 3 and o_orderkey >= 10 then o_orderkey - 10 end as parent_job_id,
 case when o_orderkey % 2 = 0 then 'document-job:' else 'document-job-' end || cast(o_orderkey as {d.text}) as queue_id,
 {at} as created_at,
 {d.add_seconds(at, '60')} as started_at,
 case when o_orderstatus in ('F', 'P') then {d.add_seconds(at, '60 + (o_orderkey * 37) % 5000')} end as finished_at,
 case when o_orderkey % 26 = 0 then null else {d.add_seconds(at, 'o_orderkey % 300')} end as heartbeat_at
from orders"""


def _attempts(d) -> str:
    return f"""
select job_id, attempt_number, status, error_class,
 started_at,
 case when status <> 'processing' then {d.add_seconds('started_at', 'spent')} end as finished_at,
 case when status <> 'processing' then cast(spent * 1000 as bigint) end as duration_ms,
 status = 'retry_scheduled' as retryable,
 case when error_class is not null then 'failure' end as error_code
from (select l_orderkey as job_id, cast(rn as int) as attempt_number,
 case when l_orderkey % 13 = 0 and rn = 1 + l_orderkey % 3 then 'processing'
      when l_linenumber = 7 then 'abandoned'
      when l_returnflag = 'N' then 'completed' when l_returnflag = 'A' then 'retry_scheduled' else 'failed' end as status,
 case when l_returnflag = 'N' then null else case l_partkey % 6 when 0 then 'StorageUnavailable' when 1 then 'ProcessingTimeout' when 2 then 'InvalidDocument' when 3 then 'ConnectionError' when 4 then 'ValueError' else 'DeterministicExtractionFailure' end end as error_class,
 {d.add_seconds('cast(l_shipdate as timestamp)', 'l_partkey % 86400')} as started_at,
 cast(l_quantity * 20 as bigint) as spent
from (select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) rn from lineitem) x) y"""


def _edges(d) -> str:
    return """
select o_orderkey as relationship_id, o_custkey % 5 as tenant_id, o_orderkey as source_document_id,
 case when o_orderkey % 17 = 0 then o_orderkey when o_orderkey % 19 = 0 then -1 else o_orderkey - 1 - (o_orderkey % 3) end as target_document_id,
 case when o_orderkey % 23 = 0 then 'copy' else case o_orderkey % 6 when 0 then 'amends' when 1 then 'statement_of_work' when 2 then 'exhibit' when 3 then 'renewal' when 4 then 'supersedes' else 'related' end end as relationship_type,
 cast(o_orderdate as timestamp) as created_at, case when o_orderkey % 4 <> 0 then o_custkey % 20 end as created_by_id
from orders
union all
select 1000000000000 + l_partkey as relationship_id, 1 as tenant_id, min(l_orderkey) as source_document_id,
 min(l_orderkey) - 1 - (min(l_orderkey) % 3) as target_document_id, 'related' as relationship_type,
 cast(min(l_shipdate) as timestamp) as created_at, 7 as created_by_id
from lineitem group by l_partkey"""


def _audit(d) -> str:
    return """
select event_id as audit_id, user_id % 5 as tenant_id, user_id, event_id % 1500 as document_id,
 case event_type when 'signup' then 'auth.login' when 'purchase' then 'document.upload' when 'error' then 'job.recovered' when 'view' then 'document.download_token' else 'document.update' end as action,
 props as details, cast(ts as timestamp) as created_at
from events"""


def _doc_pages(d) -> str:
    size = "(40 * (1 + doc_id % 10))"
    return f"""
select doc_id, cast(n as int) as page_no, substr(text, cast((n - 1) * {size} + 1 as int), cast({size} as int)) as text
from (select doc_id, text, {d.numbers(f"ceil(length(text) / cast({size} as double))")} as n from documents where length(text) > 0) p"""


def _paragraphs(d) -> str:
    select = f"select doc_id, {d.lines('text')} from documents"
    return f"select doc_id, cast(position + 1 as int) as paragraph_no, line as text from ({select}) p"


def _heartbeats(d) -> str:
    at = "timestamp '2024-01-01 00:00:00'"
    return f"""
select l_orderkey as job_id, {d.add_seconds(at, '(l_orderkey % 1000) * 3600 + l_linenumber * (50 + l_partkey % 60)')} as heartbeat_at
from lineitem"""


def _requests(d) -> str:
    return f"""
select event_id as request_id, case when event_type in ('signup', 'error') then 'auth' else 'upload' end as bucket,
 'client-' || cast(user_id % 10 as {d.text}) as client, {d.from_micros(d.whole(d.micros('ts'), 2000))} as seen_at
from events"""


def _changes(d) -> str:
    return """
select event_id as change_id, event_id % 1500 as job_id, cast(ts as timestamp) as changed_at,
 case event_type when 'signup' then 'pending' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'queued' else 'processing' end as status
from events"""


def _detections(d) -> str:
    return """
select l_orderkey as doc_id, l_linenumber - 1 as page,
 row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as seq,
 (3500 + cast(round(l_discount * 100) as int) * 60) / cast(10000 as double) as confidence,
 cast(l_partkey % 100 as double) as x1, cast(l_suppkey % 100 as double) as y1
from lineitem"""


def _vendor_master(d) -> str:
    return """
select c_custkey as pos, replace(c_name, '#', case when c_custkey % 2 = 0 then ' ' else '-' end) || case c_custkey % 3 when 0 then ' Company' when 1 then ', Inc' else '' end as master_vendor
from customer where c_nationkey <> 3"""


def _replies(d) -> str:
    kind = "case doc_id % 8 when 0 then 'MSA' when 1 then 'sow' when 2 then 'NDA' when 3 then 'PO' when 4 then 'AMD' when 5 then 'LICENSE' when 6 then 'CONTRACT' else 'MEMO' end"
    pair = f"""'{{"doc_type": "' || {kind} || '", "vendor": "' || vendor || '"}}'"""
    return f"""
select doc_id, case doc_id % 6 when 0 then {pair} when 1 then 'Answer: ' || {pair} || ' done'
 when 2 then 'doc type: ' || {kind} || ', vendor: ' || vendor when 3 then '' when 4 then 'no idea'
 else 'Vendor = "' || replace(vendor, '.', '') || '".' || chr(10) || 'doc_type=' || {kind} end as reply
from contracts"""


def _patch_columns(d) -> str:
    return f"""
select doc_id, 1 as seq, doc_id % 20 as reviewer_id,
 case when doc_id % 2 = 0 then case doc_id % 6 when 0 then 'msa' when 2 then 'Nonsense' else '' end end as p_document_type,
 case when doc_id % 5 = 0 then case doc_id % 10 when 0 then 'signed' else 'supporting' end end as p_execution_status,
 case when doc_id % 7 = 0 then 'Long_Term' end as p_retention_category,
 case when doc_id % 3 = 0 then '  New ' || vendor || ' ' end as p_vendor,
 case when doc_id % 31 = 0 then repeat('n', 4001) when doc_id % 3 = 1 then 'looks fine' end as p_review_notes,
 case when doc_id % 37 = 0 then '01/02/2003' when doc_id % 4 = 1 then '1998-02-03' end as p_effective_date,
 case when doc_id % 4 = 3 then case doc_id % 8 when 3 then '' else '1990-01-01' end end as p_expiration_date,
 case when doc_id % 9 = 0 then 'true' end as p_mark_reviewed,
 case when doc_id % 11 = 0 then '2001-02-03' end as p_renewal_date,
 case when doc_id % 13 = 0 then case doc_id % 26 when 0 then 'soon' else '2002-03-04' end end as p_review_date,
 case when doc_id % 17 = 0 then '' end as p_termination_date
from contracts
union all
select doc_id, 2 as seq, 1, 'NDA', null, null, null, null, null, null, null, null, null, null from contracts where review_status = 'reviewed'
union all
select doc_id, 3, 2, null, null, null, 'Third', null, case when doc_id % 12 = 1 then '2030-01-01' end, '2020-01-01', null, '2003-04-05', null, '2004-05-06'
from contracts where doc_id % 4 in (1, 2)
union all
select doc_id, 3, 5, null, null, null, 'Same place', null, null, '2035-01-01', 'true', null, '2005-06-07', null from contracts where doc_id % 6 = 1
union all
select -1 - c_custkey, 1, 1, 'NDA', null, null, null, null, null, null, null, null, null, null from customer"""


def _tracked(d) -> str:
    return f"""
select 'track-' || cast(doc_id as {d.text}) as tracking_id, vendor, document_type, original_name as filename,
 case when doc_id % 41 = 0 then 'not-a-date' else {d.iso_date('expiration_date')} end as expiration_date,
 {d.iso_date('renewal_date')} as renewal_date, {d.iso_date('review_date')} as review_date, retention_category
from contracts"""


def _files(d) -> str:
    body = "case doc_id % 4 when 0 then case when doc_id % 12 = 0 then '' else '%PDF-1.7 ' end when 1 then 'PK' else '' end || text || case when doc_id % 59 = 0 then 'X5O!EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*' else '' end"
    return f"""
select path, {d.binary('body')} as content, cast(length(body) as bigint) as length, created_at as {'modificationTime'}
from (select path, created_at, doc_id, {body} as body from contracts) f"""


VIEWS = {
    "contracts": _contracts, "jobs": _jobs, "attempts": _attempts, "edges": _edges, "audit": _audit,
    "doc_pages": _doc_pages, "paragraphs": _paragraphs, "heartbeats": _heartbeats,
    "requests": _requests, "changes": _changes, "detections": _detections,
    "vendor_master": _vendor_master, "replies": _replies, "patch_columns": _patch_columns,
    "tracked": _tracked, "files": _files,
}
_ON_CONTRACTS = ("replies", "patch_columns", "tracked", "files")


class Data:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str, spread: bool = False):
        self.spark, self.folder, self._spread = spark, folder.rstrip("/"), spread

    @property
    def wide(self) -> Data:
        """The same tables for work that is heavy per row (see ``spread``)."""
        return Data(self.spark, self.folder, spread=True)

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if self._spread and name == "documents" else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        sql = VIEWS[name](SparkDialect())
        used = {t: self.table(t) for t in BASE_TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
        if name in _ON_CONTRACTS:
            used["contracts"] = self.contracts
        sql = sql.replace("{", "{{").replace("}", "}}")
        if self._spread and "from orders join customer on o_custkey = c_custkey" in sql:
            # the rows are dealt after the join, before the texts are made
            orders = used.pop("orders")
            filed = orders.join(used.pop("customer"), F.col("o_custkey") == F.col("c_custkey"))
            sql = sql.replace("from orders join customer on o_custkey = c_custkey", "from {filed}")
            return self.spark.sql(sql, filed=spread(filed, orders), **used)
        for table in used:
            sql = re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", sql)
        return self.spark.sql(sql, **used)


def check_sql(query: str) -> str:
    """Put the views a checking query names in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if name in _ON_CONTRACTS and "contracts" not in needed:
                    needed.append("contracts")
                needed.append(name)

    need(query)
    order = [n for n in VIEWS if n in needed]
    parts = [f"{n} as ({VIEWS[n](CheckDialect()).strip()})" for n in order]
    if not parts:
        return query
    body = query.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(parts) + "\n" + body
