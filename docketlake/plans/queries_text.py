"""Queries on document text: type, signatures, dates, vendors, pages, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake import fixed
from docketlake.functions import dates, doctype, regions, replies, signatures, vendors
from docketlake.functions.text import iso_date
from docketlake.operators import corpus, documents, intake, pages
from docketlake.operators import signatures as visual
from docketlake.operators import vendors as vendor_jobs
from docketlake.plans.catalog import Data, number, query, scratch
from docketlake.sources import files as file_sources
from docketlake.sources import sinks


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _edges(pattern: str) -> str:
    """The same word edges for an engine without look-around."""
    return pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")


SPACE = r"'^\s+|\s+$'"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, {SPACE}, '', 'g')"


# --- document type -------------------------------------------------------------------


def _type_check(source: str, text: str, name: str, key: str = "doc_id") -> str:
    """Scores per type; the dotted abbreviation needs look-ahead and is not in the data."""
    scores = []
    for kind, patterns in fixed.TYPE_PATTERNS.items():
        terms = [
            f"len(regexp_extract_all(everything, {_lit(_edges(p))})) * case when regexp_matches(name, {_lit(_edges(p))}) then 3 else 1 end"
            for p in patterns if "p\\.o" not in p
        ]
        scores.append(f"{' + '.join(terms)} as s_{kind}")
    kinds = list(fixed.TYPE_PATTERNS)
    best = f"greatest({', '.join('s_' + k for k in kinds)})"
    chain = " ".join(f"when s_{k} = {best} then '{k}'" for k in kinds)
    return f"""
select {key}, case when {best} = 0 then 'CONTRACT' {chain} end as document_type from (select {key}, {', '.join(scores)} from (
select {key}, name, lower(name || ' ' || {text}) as everything from (
select *, regexp_replace(lower({name}), '[_-]+', ' ', 'g') as name from {source}) n) e) s"""


@query("classify_type", _type_check("contracts", "text", "original_name"))
def classify_type(d: Data):
    kind = doctype.document_type(F.col("text"), F.col("original_name"))
    return d.wide.contracts.select("doc_id", kind.alias("document_type"))


@query("classify_type_texts", _type_check("documents", "text", "source"))
def classify_type_texts(d):
    kind = doctype.document_type(F.col("text"), F.col("source"))
    return d.wide.documents.select("doc_id", kind.alias("document_type"))


@query("retention_category", """
select doc_id, case when document_type in ('MSA', 'CONTRACT', 'AGREEMENT') then case when expiration_date is not null then 'long_term' else 'indefinite' end
 when document_type in ('NDA', 'LICENSE') then 'indefinite' when document_type in ('PO', 'INVOICE') then 'short_term'
 when document_type = 'AMD' then 'tied_to_parent' when document_type = 'SOW' then 'contracts' else 'review_required' end as retention_category
from contracts""")
def retention_category(d):
    kind = doctype.retention_category(F.col("document_type"), F.col("expiration_date").isNotNull())
    return d.contracts.select("doc_id", kind.alias("retention_category"))


def _score_check(kind: str) -> str:
    words = fixed.SCORE_WORDS[kind]
    parts = [f"3 * cast(contains(lower(original_name), {_lit(w)}) as bigint)" for w in words["filename"]]
    parts += [f"cast(contains(lower(text), {_lit(w)}) as bigint)" for w in words["content"]]
    return f"{' + '.join(parts)} as {kind}_score"


@query("keyword_score", f"select doc_id, {', '.join(_score_check(k) for k in fixed.SCORE_WORDS)} from contracts")
def keyword_score(d):
    name, text = F.lower("original_name"), F.lower("text")
    scores = [doctype.keyword_score(name, text, k).cast("long").alias(f"{k}_score") for k in fixed.SCORE_WORDS]
    return d.wide.contracts.select("doc_id", *scores)


# --- signatures ------------------------------------------------------------------------


def _signature_check(source: str) -> str:
    reach = fixed.SIGNATURE_WINDOW
    windows = []
    for word in fixed.SIGNATURE_KEYWORDS:
        n, w = len(word), _lit(word)
        start = f"coalesce(list_sum(list_transform(string_split(t, {w})[1:i], lambda p: length(p))), 0) + (i - 1) * {n}"
        windows.append(
            f"list_transform(list_transform(range(1, len(string_split(t, {w}))), lambda i: cast({start} as bigint)), "
            f"lambda s: substr(t, greatest(s - {reach}, 0) + 1, least(s, {reach}) + {reach + n}))"
        )
    hits = ", ".join(f"regexp_extract_all(w, {_lit('(?im)' + p)})" for p in fixed.SIGNATURE_PATTERNS)
    tidy = _strip("regexp_replace(h, '\\s+', ' ', 'g')")
    return f"""
found as (select doc_id, list_sort(list_distinct(list_filter(list_transform(
 flatten(list_transform(windows, lambda w: flatten([{hits}]))), lambda h: {tidy}), lambda h: h <> ''))) as strings
from (select doc_id, flatten([{', '.join(windows)}]) as windows from (select doc_id, lower(text) as t from {source}) l) w)"""


def _signed(df):
    return df.withColumn("signatures", signatures.signatures(F.col("text")))


@query("detect_signatures", "with " + _signature_check("contracts") + """
select doc_id, cast(len(strings) as bigint) as signature_count, array_to_string(strings, '|') as strings from found""")
def detect_signatures(d):
    found = _signed(d.wide.contracts)
    return found.select(
        "doc_id", F.size("signatures").cast("long").alias("signature_count"),
        F.array_join(F.array_sort("signatures"), "|").alias("strings"),
    )


@query("detect_signatures_texts", "with " + _signature_check("documents") + """
select doc_id, cast(len(strings) as bigint) as signature_count from found""")
def detect_signatures_texts(d):
    found = _signed(d.wide.documents)
    return found.select("doc_id", F.size("signatures").cast("long").alias("signature_count"))


PHRASES = " or ".join(f"contains(lower(text), {_lit(p)})" for p in fixed.HIGH_CONFIDENCE_PHRASES)


@query("classify_status", "with " + _signature_check("contracts") + """
select doc_id, case when len(strings) > 0 then 'final' else 'supporting' end as execution_status from found""")
def classify_status(d):
    found = _signed(d.wide.contracts)
    status = signatures.execution_status(F.lit(0), F.col("signatures"))
    return found.select("doc_id", status.alias("execution_status"))


ROLLUP = """rolled as (select doc_id, count(*) as signature_count, count(*) filter (where confidence >= 0.4) as high_count,
 count(*) filter (where confidence < 0.4) as medium_count from detections group by doc_id)"""


@query("signature_rollup", "with " + ROLLUP + """,
ranked as (select *, row_number() over (partition by doc_id order by page, seq) as rn from detections),
top5 as (select doc_id, string_agg(cast(page as varchar) || ':' || cast(round(confidence * 10000) as integer)::varchar, ',' order by page, seq) as first_detections
 from ranked where rn <= 5 group by doc_id)
select r.*, case when high_count > 0 then 'high' else 'medium' end as confidence, medium_count > 0 and high_count = 0 as review_required, first_detections
from rolled r join top5 on top5.doc_id = r.doc_id""")
def signature_rollup(d):
    rolled = visual.signature_rollup(detections(d))
    shown = F.transform("detections", lambda x: F.concat_ws(":", x["page"], F.round(x["confidence"] * 10000).cast("int")))
    return rolled.withColumn("first_detections", F.array_join(shown, ",")).drop("detections")


def detections(d: Data):
    return d.detections.select(
        "doc_id", "page", "seq", "confidence", F.array("x1", "y1", "x1", "y1").alias("bbox"), F.lit("rfdetr").alias("source")
    )


@query("signature_analysis", "with " + _signature_check("contracts") + ", " + ROLLUP + f"""
select c.doc_id, r.doc_id is not null or len(strings) > 0 as has_signatures,
 cast(coalesce(r.signature_count, len(strings)) as bigint) as signature_count,
 case when r.high_count > 0 then 'high' when r.doc_id is not null then 'medium'
 when {PHRASES} or len(strings) >= 3 then 'high' when len(strings) >= 1 then 'medium' else 'none' end as confidence,
 coalesce(r.medium_count > 0 and r.high_count = 0, false) as review_required,
 case when r.doc_id is not null then 'rfdetr' when len(strings) > 0 then 'regex' else 'none' end as detection_source,
 case when coalesce(r.medium_count > 0 and r.high_count = 0, false) then 'needs_review' else 'not_required' end as routed
from contracts c join found f on f.doc_id = c.doc_id left join rolled r on r.doc_id = c.doc_id and c.original_name like '%.pdf'""")
def signature_analysis(d):
    rolled = visual.signature_rollup(detections(d))
    rolled = rolled.select("doc_id", F.struct(*[c for c in rolled.columns if c != "doc_id"]).alias("seen"))
    docs = d.wide.contracts.join(rolled, "doc_id", "left").withColumn(
        "seen", F.when(F.col("original_name").endswith(".pdf"), F.col("seen"))
    )
    found = _signed(docs)
    analysis = signatures.signature_analysis(F.col("text"), F.col("signatures"), F.col("seen"))
    full = found.withColumn("signature_analysis", analysis).withColumn(
        "routed", signatures.review_status(F.col("signature_analysis.review_required"))
    )
    fields = ("has_signatures", "signature_count", "confidence", "review_required", "detection_source")
    return number(full.select("doc_id", *[F.col(f"signature_analysis.{f}") for f in fields], "routed"), "signature_count")


@query("route_review", """
select doc_id, case when count(*) filter (where confidence >= 0.4) = 0 then 'needs_review' else 'not_required' end as review_status
from detections group by doc_id""")
def route_review(d):
    rolled = visual.signature_rollup(detections(d))
    return rolled.select("doc_id", signatures.review_status(F.col("review_required")).alias("review_status"))


# --- dates --------------------------------------------------------------------------------

def _parse(sql: str) -> str:
    numbers = f"regexp_extract_all({sql}, '[0-9]+')"
    month = f"lower(regexp_extract({sql}, '(?i){'|'.join(dates.MONTHS)}'))"
    year = f"(case when length({numbers}[3]) = 4 then {numbers}[3] when {numbers}[3] >= '69' then '19' || {numbers}[3] else '20' || {numbers}[3] end)"
    named = (f"list_filter({numbers}, lambda n: length(n) = 4)[1] || '-' || cast(list_position({list(dates.MONTHS)}, {month}) as varchar) || '-' || "
             f"coalesce(list_filter({numbers}, lambda n: length(n) < 4)[1], '1')")
    return (f"cast(try_strptime(case when {month} <> '' then {named} when length({numbers}[1]) = 4 then array_to_string({numbers}, '-') "
            f"when cast({numbers}[1] as int) > 12 then {year} || '-' || {numbers}[2] || '-' || {numbers}[1] "
            f"else {year} || '-' || {numbers}[1] || '-' || {numbers}[2] end, '%Y-%-m-%-d') as date)")


ONE_DATE = _lit(f"(?i)(?:^|[^A-Za-z0-9])({dates.DATE_TEXT})")


@query("extract_latest_date", f"""
select doc_id, strftime(list_max(list_filter(list_transform(
 regexp_extract_all(text || chr(10) || original_name, {ONE_DATE}, 1), lambda x: {_parse('x')}),
 lambda x: year(x) between 1990 and 2035)), '%Y%m%d') as date_str from contracts""")
def extract_latest_date(d):
    return d.wide.contracts.select("doc_id", dates.latest_date(F.col("text"), F.col("original_name")).alias("date_str"))


def _lifecycle(kind: str) -> str:
    clauses = ", ".join(f"regexp_extract_all(text, {_lit('(?i)' + p)}, 1)[1:3]" for p in fixed.LIFECYCLE_PATTERNS[kind])
    first = f"regexp_extract(c, {ONE_DATE}, 1)"
    return f"""strftime(list_filter(list_transform(flatten([{clauses}]), lambda c: {_parse(first)}),
 lambda x: year(x) between 1990 and 2040)[1], '%Y-%m-%d') as {kind}"""


KINDS = tuple(fixed.LIFECYCLE_PATTERNS)


@query("extract_lifecycle_dates", f"""
select doc_id, {', '.join(_lifecycle(k) for k in KINDS)}, cast(null as varchar) as signature_date from contracts""")
def extract_lifecycle_dates(d):
    found = d.wide.contracts.select("doc_id", dates.lifecycle_dates(F.col("text")).alias("found"))
    return found.select("doc_id", *[iso_date(F.col(f"found.{k}")).alias(k) for k in (*KINDS, "signature_date")])


@query("archive_by_year", f"""
with dated as (select path, original_name, year(list_max(list_filter(list_transform(
 regexp_extract_all(text || chr(10) || original_name, {ONE_DATE}, 1), lambda x: {_parse('x')}),
 lambda x: year(x) between 1990 and 2035))) as y from contracts where original_name not like '%.txt')
select path, original_name, y as year, case when y is null then 'Moved to error folder' when y < 1999 then 'Moved to pre-1999' else 'Kept in place' end as action,
 case when y is null then 'No dates found' end as error from dated""")
def archive_by_year(d):
    files = d.contracts.where(F.regexp_extract("original_name", r"(\.[^.]*)$", 1).isin(*fixed.ARCHIVE_EXTENSIONS))
    plan = dates.archive_plan(files, F.col("text"), F.col("original_name"), 1999)
    return number(plan.select("path", "original_name", "year", "action", "error"), "year")


@query("archive_summary", f"""
select action, count(*) as files from (select case when y is null then 'Moved to error folder' when y < 2000 then 'Moved to pre-2000' else 'Kept in place' end as action
 from (select year(list_max(list_filter(list_transform(
 regexp_extract_all(text || chr(10) || original_name, {ONE_DATE}, 1), lambda x: {_parse('x')}),
 lambda x: year(x) between 1990 and 2035))) as y from contracts) z) a group by action""")
def archive_summary(d):
    path = scratch(d.spark, "archive")
    plan = dates.archive_plan(d.contracts, F.col("text"), F.col("original_name"), 2000)
    sinks.write_csv(plan.select("path", "original_name", "year", "action", "error"), path)
    return d.spark.read.csv(path, header=True).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


# --- regions and pages -------------------------------------------------------------------------


def _region(text: str) -> str:
    return " or ".join(f"regexp_matches({text}, {_lit('(?i)' + p)})" for p in fixed.REGION_PATTERNS)


@query("has_region", f"select doc_id, {_region('text')} as region_found from contracts")
def has_region(d):
    return d.wide.contracts.select("doc_id", regions.has_region(F.col("text")).alias("region_found"))


@query("has_region_texts", f"select doc_id, {_region('text')} as region_found from documents")
def has_region_texts(d):
    return d.wide.documents.select("doc_id", regions.has_region(F.col("text")).alias("region_found"))


def _digest(df, text: str = "text"):
    return df.withColumn("text_md5", F.md5(F.col(text))).drop(text)


@query("document_text", f"""
with kept as (select doc_id, coalesce(string_agg(text, chr(10) order by page_no) filter (where length({_strip('text')}) > 10), '') as joined
 from doc_pages where page_no <= 5 group by doc_id)
select doc_id, md5(substr(joined, 1, 5000)) as text_md5, length({_strip('joined')}) < 50 as needs_ocr from kept""")
def document_text(d):
    return _digest(pages.document_text(d.wide.doc_pages))


@query("paragraphs_to_text", """
select doc_id, md5(substr(string_agg(text || chr(10), '' order by paragraph_no), 1, 5000)) as text_md5 from paragraphs group by doc_id""")
def paragraphs_to_text(d):
    return _digest(pages.paragraphs_to_text(d.paragraphs))


@query("tail_pages_text", """
select doc_id, md5(string_agg(text || chr(10), '' order by page_no)) as text_md5
from (select *, row_number() over (partition by doc_id order by page_no desc) as rn from doc_pages) x where rn <= 5 group by doc_id""")
def tail_pages_text(d):
    return _digest(pages.tail_pages_text(d.wide.doc_pages), "tail_text")


FRONT = f"""texts as (select doc_id, list(text order by page_no) as texts from doc_pages where page_no <= 7 group by doc_id),
steps as (select doc_id, s, len(texts) as n, {_strip("array_to_string(list_transform(list_filter(texts[1:s], lambda t: t <> ''), lambda t: t || chr(10)), '')")} as text
 from (select *, unnest(range(least(2, len(texts)), len(texts) + 1)) as s from texts) u),
judged as (select *, text <> '' and ({_region('text')}) as region from steps),
stops as (select *, row_number() over (partition by doc_id order by s) as rn from judged where s = n or (text <> '' and (region or length(text) >= 200))),
front as (select doc_id, text, region, s from stops where rn = 1)"""


@query("widen_front_pages", f"with {FRONT} select doc_id, md5(text) as text_md5, region as region_found, cast(s as bigint) as pages_read from front")
def widen_front_pages(d):
    return number(_digest(pages.widen_front_pages(d.wide.doc_pages)), "pages_read")


# --- vendors ---------------------------------------------------------------------------------------


def _normal(sql: str) -> str:
    """Suffixes with dots never remain after their plain forms are removed here."""
    out = f"lower({sql})"
    for suffix in fixed.VENDOR_SUFFIX_PATTERNS:
        if "\\." not in suffix:
            out = f"regexp_replace({out}, {_lit(_edges(suffix))}, '', 'g')"
    out = f"regexp_replace({out}, '[^\\w\\s]', ' ', 'g')"
    return _strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")


def _clean(sql: str) -> str:
    kept = f"regexp_replace({sql}, '[^\\w\\s-]|[\\s-]+', '', 'g')"
    return f"case when {kept} = '' then 'UnknownVendor' else upper(substr({kept}, 1, 1)) || substr({kept}, 2) end"


def _words(values) -> str:
    return ", ".join(_lit(v) for v in values)


FOLDER = f"""case when folder <> '' and not regexp_matches(folder, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
 and lower(folder) not in ({_words(fixed.GENERIC_FOLDERS)}) then coalesce(nullif(array_to_string(
 list_filter(regexp_split_to_array(lower(folder), '[\\s_-]+'), lambda w: w not in ({_words(fixed.FOLDER_SUFFIX_WORDS)}) and w <> ''), ' '), ''), folder) end"""
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(original_name, '\.[A-Za-z0-9]+$', ''), '[\s_\-]+'), lambda t: t <> '')"
STOP = f"list_position(list_transform({TOKENS}, lambda t: lower(t) in ({_words(fixed.FILENAME_STOP_WORDS)}) or regexp_matches(t, '^\\d{{2,4}}$')), true)"
FILENAME = f"nullif(array_to_string({TOKENS}[1:case when coalesce({STOP}, 0) > 0 then {STOP} - 1 else len({TOKENS}) end], ' '), '')"


@query("normalize_vendor", f"select doc_id, {_normal('vendor')} as vendor_key from contracts")
def normalize_vendor(d):
    return d.contracts.select("doc_id", vendors.normalize_vendor(F.col("vendor")).alias("vendor_key"))


@query("clean_vendor", f"select doc_id, {_clean('vendor')} as clean_vendor from contracts")
def clean_vendor(d):
    return d.contracts.select("doc_id", vendors.clean_vendor(F.col("vendor")).alias("clean_vendor"))


@query("vendor_from_folder", f"select doc_id, {FOLDER} as vendor from contracts")
def vendor_from_folder(d):
    return d.contracts.select("doc_id", vendors.vendor_from_folder(F.col("folder")).alias("vendor"))


@query("vendor_from_filename", f"select doc_id, {FILENAME} as vendor from contracts")
def vendor_from_filename(d):
    return d.contracts.select("doc_id", vendors.vendor_from_filename(F.col("original_name")).alias("vendor"))


@query("vendor_cascade", f"select doc_id, coalesce({FOLDER}, {FILENAME}, 'Unknown') as vendor from contracts")
def vendor_cascade(d):
    found = vendors.vendor_cascade(F.lit(""), F.col("folder"), F.col("original_name"), "Unknown")
    return d.contracts.select("doc_id", found.alias("vendor"))


EXACT = f"exact as (select {_normal('master_vendor')} as vendor_key, min_by(master_vendor, pos) as exact_vendor from vendor_master group by 1)"


@query("match_vendors_exact", f"""
with {EXACT} select doc_id, coalesce(exact_vendor, vendor) as matched_vendor, case when exact_vendor is null then 0.0 else 100.0 end::double as match_score
from contracts left join exact on vendor_key = {_normal('vendor')}""")
def match_vendors_exact(d):
    return vendor_jobs.match_vendors(d.wide.contracts, d.vendor_master, fuzzy=False).select(
        "doc_id", "matched_vendor", "match_score"
    )


@query("match_vendors")
def match_vendors(d):
    """Names with two letters swapped find their master through the fuzzy search."""
    swapped = F.when(F.col("doc_id") % 10 == 0, F.translate("vendor", "Cu", "uC")).otherwise(F.col("vendor"))
    docs = d.contracts.withColumn("vendor", swapped)
    return vendor_jobs.match_vendors(docs, d.vendor_master).select("doc_id", "matched_vendor", "match_score")


@query("match_vendors_edited", f"""
with {EXACT}, sized as (select {_normal('master_vendor')} as norm, min(pos) as pos from vendor_master group by 1)
select pos, exact_vendor as matched_vendor, round(200.0 * length(norm) / (2 * length(norm) + 2), 6) as match_score
from sized join exact on vendor_key = norm""")
def match_vendors_edited(d):
    """Every master with two letters added that no name has: its length alone fixes the ratio of the best match."""
    first = d.vendor_master.groupBy(vendors.normalize_vendor(F.col("master_vendor")).alias("norm")).agg(F.min("pos").alias("pos"))
    docs = first.select("pos", F.concat(F.col("norm"), F.lit("ßñ")).alias("vendor"))
    return vendor_jobs.match_vendors(docs, d.vendor_master).select(
        "pos", "matched_vendor", F.round("match_score", 6).alias("match_score"))


@query("vendor_dimension", f"""
with named as (select coalesce({FOLDER}, {FILENAME}, '') as vendor, count(*) as n from contracts group by 1),
{EXACT}, matched as (select coalesce(exact_vendor, vendor) as vendor, n from named left join exact on vendor_key = {_normal('vendor')} and vendor <> '')
select vendor, {_normal('vendor')} as vendor_key, {_clean('vendor')} as clean_vendor, documents
from (select vendor, cast(sum(n) as bigint) as documents from matched group by vendor) m""")
def vendor_dimension(d):
    docs = d.wide.contracts.withColumn("model_vendor", F.lit(""))
    return vendor_jobs.vendor_dimension(docs, d.vendor_master, fuzzy=False)


@query("vendor_counts", f"select {_clean('vendor')} as clean_vendor, count(*) as documents from contracts group by 1")
def vendor_counts(d):
    return documents.vendor_counts(d.contracts.withColumn("clean_vendor", vendors.clean_vendor(F.col("vendor"))))


@query("vendor_type_counts", f"select {_clean('vendor')} as clean_vendor, document_type, count(*) as documents from contracts group by 1, 2")
def vendor_type_counts(d):
    return documents.vendor_type_counts(d.contracts.withColumn("clean_vendor", vendors.clean_vendor(F.col("vendor"))))


# --- model replies, labels and training rows --------------------------------------------------------

ANSWER_TYPE = """upper(regexp_extract(reply, '(?i)doc[_\\s-]?type"?\\s*[:=]\\s*"?([A-Za-z]+)', 1))"""
MODEL = ", ".join(f"'{t}'" for t in fixed.MODEL_TYPES)


@query("parse_model_output", f"""
with told as (select doc_id, {ANSWER_TYPE} as kind,
 case when doc_id % 6 in (0, 1) then regexp_extract(reply, '"vendor": "([^"]*)"', 1)
 else rtrim(trim(trim({_strip("regexp_extract(reply, '(?i)vendor\\s*[:=]\\s*([^\\n,;]+)', 1)")}, '"'), ''''), '.') end as vendor from replies)
select doc_id, case when kind in ({MODEL}) then kind else '' end as doc_type,
 case when doc_id % 6 in (0, 1) and kind not in ({MODEL}) then '' else vendor end as vendor from told""")
def parse_model_output(d):
    return d.replies.select("doc_id", replies.parsed_reply(F.col("reply")).alias("answer")).select(
        "doc_id", "answer.doc_type", "answer.vendor"
    )


@query("truncate_prompt", f"select doc_id, md5({_lit(fixed.MODEL_INSTRUCTION)} || substr(text, 1, 2000)) as prompt_md5 from documents")
def truncate_prompt(d):
    return d.table("documents").select("doc_id", F.md5(replies.truncate_prompt(F.col("text"))).alias("prompt_md5"))


LABELS = f"""labels_made as (select c.doc_id, c.text, t.document_type as doc_type, coalesce({FOLDER}, {FILENAME}, '') as vendor
 from contracts c join ({_type_check('contracts', 'text', 'original_name')}) t on t.doc_id = c.doc_id where c.text <> '')"""


ALL_LABELS = LABELS.replace("where c.text <> ''", "")


@query("pseudo_labels", f"with {LABELS} select doc_id, text, doc_type, vendor, doc_type = 'CONTRACT' as is_default, 'regex' as source from labels_made")
def pseudo_labels(d):
    return corpus.pseudo_labels(d.wide.contracts)


@query("pseudo_labels_without_defaults", f"with {LABELS} select doc_id, doc_type, vendor from labels_made where doc_type <> 'CONTRACT' and vendor <> ''")
def pseudo_labels_without_defaults(d):
    return corpus.pseudo_labels(d.wide.contracts, exclude_defaults=True, vendor_source="folder").select("doc_id", "doc_type", "vendor")


@query("write_pseudo_labels", f"with {LABELS} select doc_id, doc_type, vendor, md5(text) as text_md5 from labels_made")
def write_pseudo_labels(d):
    path = scratch(d.spark, "labels")
    sinks.write_pseudo_labels(corpus.pseudo_labels(d.wide.contracts), path)
    return _digest(file_sources.read_pseudo_labels(d.spark, path).select("doc_id", "doc_type", "vendor", "text"))


@query("training_pairs", f"""with {LABELS} select doc_id, md5({_lit(fixed.MODEL_INSTRUCTION)} || substr({_strip('text')}, 1, 2000)) as prompt_md5,
 '{{"doc_type": "' || doc_type || '", "vendor": "' || vendor || '"}}' as target from labels_made""")
def training_pairs(d):
    pairs = corpus.training_pairs(corpus.pseudo_labels(d.wide.contracts))
    return pairs.select("doc_id", F.md5("prompt").alias("prompt_md5"), "target")


@query("train_eval_split", """
select doc_id, case when row_number() over (order by doc_id) <= cast(floor((select count(*) from documents) * 0.9) as bigint) then 'train' else 'eval' end as split from documents""")
def train_eval_split(d):
    return corpus.train_eval_split(d.table("documents").select("doc_id"))


# --- the whole analysis ---------------------------------------------------------------------------------


def analysed(d: Data, **options):
    return intake.analyze_documents(d.wide.contracts.select("doc_id", "path", "folder", "original_name", "text"), **options)


ANALYSED = f"""with {_signature_check("contracts")}, {ALL_LABELS},
expiry as (select doc_id, {_lifecycle('effective_date')}, {_lifecycle('expiration_date')} from contracts)
select c.doc_id, c.original_name, l.vendor, {_clean('l.vendor')} as clean_vendor, l.doc_type as document_type,
 case when len(f.strings) > 0 then 'final' else 'supporting' end as execution_status, e.effective_date, e.expiration_date,
 cast(len(f.strings) as bigint) as signature_count,
 case when l.doc_type in ('MSA', 'CONTRACT') then case when e.expiration_date is not null then 'long_term' else 'indefinite' end
 when l.doc_type in ('NDA', 'LICENSE') then 'indefinite' when l.doc_type = 'PO' then 'short_term' when l.doc_type = 'AMD' then 'tied_to_parent' else 'contracts' end as retention_category
from contracts c join labels_made l on l.doc_id = c.doc_id join found f on f.doc_id = c.doc_id join expiry e on e.doc_id = c.doc_id"""


@query("analyze_documents", f"select * exclude (original_name) from ({ANALYSED}) x")
def analyze_documents(d):
    return analysed(d).select(
        "doc_id", "vendor", "clean_vendor", "document_type", "execution_status",
        iso_date(F.col("date_metadata.effective_date")).alias("effective_date"),
        iso_date(F.col("date_metadata.expiration_date")).alias("expiration_date"),
        F.col("signature_analysis.signature_count").cast("long").alias("signature_count"), "retention_category",
    )


@query("analyze_paged_documents", f"""
with {FRONT},
tails as (select doc_id, string_agg(text || chr(10), '' order by page_no) as text
 from (select *, row_number() over (partition by doc_id order by page_no desc) as rn from doc_pages) x where rn <= 5 group by doc_id),
{_signature_check("tails")}, {ROLLUP},
named as (select d.doc_id, d.source, cast(d.doc_id as varchar) || '.pdf' as original_name, f.text from documents d join front f on f.doc_id = d.doc_id)
select n.doc_id, n.source as vendor, t.document_type,
 case when r.doc_id is not null or len(found.strings) > 0 then 'final' else 'supporting' end as execution_status,
 strftime(list_max(list_filter(list_transform(regexp_extract_all(n.text || chr(10) || n.original_name, {ONE_DATE}, 1), lambda x: {_parse('x')}),
 lambda x: year(x) between 1990 and 2035)), '%Y%m%d') as date_str,
 case when r.medium_count > 0 and r.high_count = 0 then 'needs_review' else 'not_required' end as review_status,
 case when r.doc_id is not null then 'rfdetr' when len(found.strings) > 0 then 'regex' else 'none' end as detection_source
from named n join ({_type_check('named', 'text', 'original_name')}) t on t.doc_id = n.doc_id
join found on found.doc_id = n.doc_id left join rolled r on r.doc_id = n.doc_id""")
def analyze_paged_documents(d):
    """Page rows to analysis: front pages for the text, tail pages for signatures."""
    raw = d.table("documents").select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"), F.col("source").alias("folder"),
        F.concat("doc_id", F.lit(".pdf")).alias("original_name"),
    )
    docs = intake.with_page_texts(raw, d.wide.doc_pages)
    return intake.analyze_documents(docs, detections=detections(d)).select(
        "doc_id", "vendor", "document_type", "execution_status", "date_str", "review_status",
        F.col("signature_analysis.detection_source").alias("detection_source"),
    )


@query("write_metadata", f"select * exclude (doc_id) from ({ANALYSED}) x")
def write_metadata(d):
    """Every stored metadata text, with the analysis it tells."""
    path = scratch(d.spark, "metadata")
    sinks.write_metadata(analysed(d), path)
    told = {name: F.get_json_object("value", f"$.{name}") for name in (
        "original_name", "vendor", "clean_vendor", "document_type", "execution_status", "retention_category")}
    told |= {name: F.get_json_object("value", f"$.date_metadata.{name}") for name in ("effective_date", "expiration_date")}
    told["signature_count"] = F.get_json_object("value", "$.signature_analysis.signature_count").cast("long")
    return d.spark.read.text(path).select(*[c.alias(name) for name, c in told.items()])


@query("score_documents", f"select doc_id, '{fixed.MODEL_TYPES[0]}' as doc_type, 'Acme' as vendor from contracts where text <> '' union all select doc_id, '', '' from contracts where text = ''")
def score_documents(d):
    from docketlake.hooks import score_documents as score

    def factory():
        return lambda text: '{"doc_type": "MSA", "vendor": "Acme"}'

    return score(d.wide.contracts.select("doc_id", "text"), factory).select("doc_id", "answer.doc_type", "answer.vendor")


@query("detect_on_pages", """
select doc_id, cast(page_no - 1 as bigint) as page, 0.5::double as confidence from doc_pages where length(text) > 100""")
def detect_on_pages(d):
    from docketlake.hooks import detect_on_pages as detect

    images = d.wide.doc_pages.select("doc_id", (F.col("page_no") - 1).alias("page"), F.col("text").cast("binary").alias("image"))

    def factory():
        def find(image: bytes):
            size = len(image.decode())
            return [(0.5 if size > 100 else 0.1, (0, 0, size, 1))]

        return find

    return number(detect(images, factory), "page").select("doc_id", "page", "confidence")


@query("extract_pages_with", """
select doc_id, cast(paragraph_no as bigint) as page_no, md5(text) as text_md5 from paragraphs""")
def extract_pages_with(d):
    from docketlake.hooks import extract_pages_with as extract

    files = d.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))

    def factory():
        return lambda content: content.decode().split("\n")

    return number(_digest(extract(files, factory)), "page_no").drop("error")
