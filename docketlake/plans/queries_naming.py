"""Queries on names, target paths and raw files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake import fixed
from docketlake.functions import naming
from docketlake.functions.vendors import clean_vendor
from docketlake.operators import files, intake
from docketlake.operators import naming as plans
from docketlake.plans.catalog import Data, number, query, scratch
from docketlake.plans.queries_text import ALL_LABELS, _clean, _lifecycle, _lit, _signature_check
from docketlake.sources import files as file_sources
from docketlake.sources import sinks

EXT = r"regexp_extract({}, '[^./][^/]*?(\.[^./]*)$', 1)"
NAME_EXT = EXT.format("original_name")


def _map(values: dict, default: str) -> str:
    whens = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in values.items())
    return f"case document_type {whens} else {_lit(default)} end"


ABBREVIATION = _map(fixed.TYPE_ABBREVIATIONS, "K")
DESCRIPTION = _map(fixed.TYPE_DESCRIPTIONS, "document")


def enhanced(vendor: str, sequence: str) -> str:
    return f"{ABBREVIATION} || '_' || {vendor} || '_' || {DESCRIPTION} || '_' || printf('%03d', cast({sequence} as bigint)) || {NAME_EXT}"


def _docs(d: Data):
    return d.wide.contracts.withColumns({
        "clean_vendor": clean_vendor(F.col("vendor")),
        "document_type": F.coalesce("document_type", F.lit("CONTRACT")),
        "execution_status": F.coalesce("execution_status", F.lit("supporting")),
        "date_str": F.date_format("effective_date", "yyyyMMdd"),
    })


DOCS = f"""docs as (select doc_id, path, folder, original_name, {_clean('vendor')} as clean_vendor, coalesce(document_type, 'CONTRACT') as document_type,
 coalesce(execution_status, 'supporting') as execution_status from contracts)"""


@query("enhanced_filename", f"with {DOCS} select doc_id, {enhanced('clean_vendor', 'doc_id')} as new_filename from docs")
def enhanced_filename(d):
    name = naming.enhanced_filename(F.col("clean_vendor"), F.col("document_type"), F.col("original_name"), F.col("doc_id"))
    return _docs(d).select("doc_id", name.alias("new_filename"))


@query("simple_filename", f"""select doc_id, case when doc_id % 3 = 0 then '' else strftime(effective_date, '%Y%m%d') || '_' end || {_clean('vendor')} || '_' || original_name as new_filename from contracts""")
def simple_filename(d):
    dated = F.when(F.col("doc_id") % 3 != 0, F.col("date_str"))
    return _docs(d).select("doc_id", naming.simple_filename(F.col("clean_vendor"), F.col("original_name"), dated).alias("new_filename"))


@query("route_folder", "select doc_id, folder || '_' || execution_status as target_folder from contracts")
def route_folder(d):
    return d.contracts.select("doc_id", naming.route_folder(F.col("folder"), F.col("execution_status")).alias("target_folder"))


@query("clean_filename", r"""
select event_id, trim(regexp_replace(regexp_replace(props || '__' || event_type || '?', '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_ ') as clean_name from events""")
def clean_filename(d):
    raw = F.concat("props", F.lit("__"), "event_type", F.lit("?"))
    return d.table("events").select("event_id", naming.clean_filename(raw).alias("clean_name"))


@query("format_file_size", """
select doc_id, case when file_size = 0 then '0B' when file_size < 1024 then printf('%.1fB', cast(file_size as double))
 when file_size < 1048576 then printf('%.1fKB', file_size / 1024.0::double) else printf('%.1fMB', file_size / 1048576.0::double) end as size_formatted from contracts""")
def format_file_size(d):
    return d.contracts.select("doc_id", naming.format_file_size(F.col("file_size")).alias("size_formatted"))


@query("tracking_id", """
select doc_id, vendor || '_' || coalesce(document_type, 'CONTRACT') || '_' ||
 printf('%04d', cast('0x' || substr(md5(path), 1, 8) as bigint) % 10000) as tracking_id from contracts""")
def tracking_id(d):
    return d.contracts.select("doc_id", naming.tracking_id(
        F.col("vendor"), F.coalesce("document_type", F.lit("CONTRACT")), F.col("path")
    ).alias("tracking_id"))


NUMBERED = "sequenced as (select *, row_number() over (partition by clean_vendor, document_type order by path) as sequence_id from docs)"
SEQUENCED = f"{DOCS}, {NUMBERED}"


@query("assign_sequence_ids", f"with {SEQUENCED} select doc_id, clean_vendor, document_type, sequence_id from sequenced")
def assign_sequence_ids(d):
    return plans.assign_sequence_ids(_docs(d).select("doc_id", "path", "clean_vendor", "document_type")).drop("path")


def _conflicts(suffix: str) -> str:
    return f"""
with asked as (select path, folder || '/' || original_name as target_path, row_number() over (partition by folder || '/' || original_name order by path) - 1 as copy from contracts)
select path, target_path, case when copy = 0 then target_path else
 substr(target_path, 1, length(target_path) - length({EXT.format('target_path')})) || '{suffix}' || printf('%02d', copy) || {EXT.format('target_path')} end as resolved_path from asked"""


def _targets(d: Data):
    return d.contracts.select("path", F.concat_ws("/", "folder", "original_name").alias("target_path"))


@query("resolve_conflicts", _conflicts("_conflict"))
def resolve_conflicts(d):
    return plans.resolve_conflicts(_targets(d))


@query("unique_names", _conflicts("_"))
def unique_names(d):
    return plans.unique_names(_targets(d))


@query("resolve_conflicts_existing", f"""
with asked as (select path, folder || '/' || original_name as target_path, row_number() over (partition by folder || '/' || original_name order by path) as n from contracts),
held as (select distinct target_path from asked where hash_group(target_path) = 0),
blocked as (select distinct target_path from asked where hash_group(target_path) = 1),
placed as (select a.path, a.target_path,
 case when h.target_path is not null then n when b.target_path is not null and n >= 3 then n when b.target_path is not null and n = 2 then 1 else n - 1 end as number
 from asked a left join held h on h.target_path = a.target_path left join blocked b on b.target_path = a.target_path)
select path, target_path, case when number = 0 then target_path else
 substr(target_path, 1, length(target_path) - length({EXT.format('target_path')})) || '_conflict' || printf('%02d', number) || {EXT.format('target_path')} end as resolved_path from placed""".replace(
    "hash_group(target_path)", "length(target_path) % 3"))
def resolve_conflicts_existing(d):
    """Some targets exist already, for others the number 02 is taken."""
    asked = _targets(d)
    group = F.length("target_path") % 3
    held = asked.where(group == 0).select("target_path")
    stem = F.regexp_replace("target_path", r"\.[^./]*$", "")
    ext = F.regexp_extract("target_path", r"(\.[^./]*)$", 1)
    second = asked.where(group == 1).select(F.concat(stem, F.lit("_conflict02"), ext).alias("target_path"))
    return plans.resolve_conflicts(asked, existing=held.union(second))


NAMED = f"{NUMBERED}, planned as (select *, {enhanced('clean_vendor', 'sequence_id')} as new_filename from sequenced)"
PLANNED = f"{DOCS}, {NAMED}"


@query("naming_plan", f"""with {PLANNED}
select path, new_filename, folder || '/' || folder || '_' || execution_status || '/' || new_filename as resolved_path from planned""")
def naming_plan(d):
    docs = _docs(d).select("path", "folder", "original_name", "clean_vendor", "document_type", "execution_status", "date_str")
    return plans.naming_plan(docs).select("path", "new_filename", "resolved_path")


FAILED = f"""failed as (select *, '_errors/' || original_name as target_path, row_number() over (partition by original_name order by path) - 1 as copy
 from contracts where error_message is not null)"""


@query("process_folders", f"""with {_signature_check("contracts")}, {ALL_LABELS},
expiry as (select doc_id, {_lifecycle('expiration_date')} from contracts),
docs as (select c.doc_id, c.path, c.folder, c.original_name, {_clean('l.vendor')} as clean_vendor, l.doc_type as document_type,
 case when len(f.strings) > 0 then 'final' else 'supporting' end as execution_status,
 case when l.doc_type in ('MSA', 'CONTRACT') then case when e.expiration_date is not null then 'long_term' else 'indefinite' end
 when l.doc_type in ('NDA', 'LICENSE') then 'indefinite' when l.doc_type = 'PO' then 'short_term' when l.doc_type = 'AMD' then 'tied_to_parent' else 'contracts' end as retention_category
 from contracts c join labels_made l on l.doc_id = c.doc_id join found f on f.doc_id = c.doc_id join expiry e on e.doc_id = c.doc_id
 where c.error_message is null),
{NAMED}, {FAILED}
select doc_id, path, folder || '/' || folder || '_' || execution_status || '/' || new_filename as resolved_path, new_filename,
 clean_vendor, document_type, execution_status, retention_category, null as error from planned
union all select doc_id, path, case when copy = 0 then target_path else
 substr(target_path, 1, length(target_path) - length({EXT.format('target_path')})) || '_conflict' || printf('%02d', copy) || {EXT.format('target_path')} end,
 null, null, null, null, null, error_message from failed""")
def process_folders(d):
    docs = d.wide.contracts.select(
        "doc_id", "path", "folder", "original_name", "text", F.col("error_message").alias("error")
    )
    return intake.process_folders(docs)


@query("publish_results", """
select doc_id, 'results/' || cast(doc_id as varchar) || '/' || original_name as location, cast(case when status = 'completed' then 1 else 0 end as bigint) as batch_id from contracts""")
def publish_results(d):
    """Two batches, the second one run twice; the latest row per document counts."""
    path = scratch(d.spark, "published")
    results = d.contracts.select("doc_id", "status", F.col("original_name").alias("new_filename"))
    sinks.publish_results(results, path, 0)
    for _ in range(2):
        sinks.publish_results(results.where("status = 'completed'"), path, 1)
    return number(sinks.read_published(d.spark, path), "batch_id").select("doc_id", "location", "batch_id")


# --- raw files ----------------------------------------------------------------------------

BODY_EXT = "lower(" + EXT.format("path") + ")"


@query("file_info", f"""
select path, length as size, {BODY_EXT} as extension from files""")
def file_info(d):
    return files.file_info(d.files).select("path", "size", "extension")


@query("count_files_by_extension", f"select {BODY_EXT} as extension, count(*) as files from files group by 1")
def count_files_by_extension(d):
    return files.count_files_by_extension(d.files)


MISMATCH = "'Uploaded file content does not match ' || e || ' extension'"
UPLOAD = f"""case when length <= 0 then 'Uploaded file is empty' when e = '.pdf' and not starts_with(body, '%PDF') then {MISMATCH}
 when e = '.docx' then {MISMATCH} end"""
SCAN = "case when length = 0 then 'error' when contains(body, 'EICAR-STANDARD-ANTIVIRUS-TEST-FILE') then 'infected' else 'clean' end"
FILES = f"(select *, {BODY_EXT} as e, decode(content) as body from files) f"


@query("validate_upload", f"select path, {UPLOAD} as upload_error from {FILES}")
def validate_upload(d):
    return files.validate_upload(d.files).select("path", "upload_error")


@query("scan_content", f"select path, {SCAN} as scan_status from {FILES}")
def scan_content(d):
    return files.scan_content(d.files).select("path", "scan_status")


@query("checksum", "select path, sha256(content) as checksum from files")
def checksum(d):
    return files.file_inventory(d.files).select("path", "checksum")


@query("file_inventory", f"""
select path, e as extension, length as size, sha256(content) as checksum, {UPLOAD} as upload_error, {SCAN} as scan_status from {FILES}""")
def file_inventory(d):
    return files.file_inventory(d.files).drop("size_formatted", "scan_message")


# Files of up to a hundred documents each, in order; what is read back is the start of each.
@query("read_text_documents", f"""
select 'source=' || source as folder, doc_id // 100 as part,
 md5(left(replace(string_agg(coalesce(text, '') || chr(10), '' order by doc_id, text), chr(65533), ''), {fixed.PLAIN_TEXT_LIMIT})) as text_md5
from documents group by source, doc_id // 100""")
def read_text_documents(d):
    """Texts written as files below one folder per source, and read back."""
    path = scratch(d.spark, "texts")
    texts = d.table("documents").select("source", F.expr("doc_id div 100").alias("part"), "doc_id", F.col("text").alias("value"))
    sinks.write_text_files(texts, path, "source", "part", ["doc_id", "value"])
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part")
    return file_sources.read_text_documents(d.spark, path).select("folder", part, F.md5("text").alias("text_md5"))


@query("read_document_files", "select 'source=' || source as folder, cast(sum(octet_length(encode(text)) + 1) as bigint) as bytes from documents group by 1")
def read_document_files(d):
    path = scratch(d.spark, "texts")
    d.table("documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return file_sources.read_document_files(d.spark, path).groupBy("folder").agg(F.sum("length").alias("bytes"))
