"""Search, listing, statistics and data-quality queries on document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake import fixed
from docketlake.functions.text import iso_date, iso_timestamp
from docketlake.operators.ordered import newest

_DATES = ("effective_date", "expiration_date", "renewal_date", "review_date", "termination_date")
VIEW_FIELDS = (
    "doc_id", "tenant_id", "uploaded_by_id", "reviewed_by_id", "original_name", "status",
    "document_type", "vendor", "execution_status", *_DATES, "retention_category",
    "generated_filename", "processed_folder", "storage_backend", "source_storage_key",
    "result_storage_key", "file_size", "checksum", "scan_status", "scan_message", "scanned_at",
    "review_status", "review_notes", "reviewed_at", "error_message", "created_at", "updated_at",
)
_TIMES = ("scanned_at", "reviewed_at", "created_at", "updated_at")
_ENUMS = ("status", "scan_status", "review_status")
_EXPORT = (
    "doc_id", "original_name", "document_type", "vendor", "execution_status", "effective_date",
    "expiration_date", "retention_category", "review_status", "created_at",
)


def tenant_scope(df: DataFrame, tenant_id: int | None) -> DataFrame:
    """Rows of one tenant; callers without a tenant see rows without one."""
    return df.where(F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))


def _shown(name: str) -> Column:
    col = F.col(name)
    if name in _DATES:
        return iso_date(col).alias(name)
    if name in _TIMES:
        return iso_timestamp(col).alias(name)
    if name in _ENUMS:
        return F.lower(col).alias(name)
    return col


def view_columns(df: DataFrame) -> dict[str, Column]:
    """The public fields that ``df`` has, as they are shown."""
    return {c: _shown(c) for c in VIEW_FIELDS if c in df.columns}


def document_view(df: DataFrame) -> DataFrame:
    """The 31 public fields, dates and times as ISO text."""
    return df.select(*[_shown(c) for c in VIEW_FIELDS])


def document_detail(df: DataFrame, doc_id: int) -> DataFrame:
    """Public fields, text and the metadata struct of one document."""
    one = df.where(F.col("doc_id") == doc_id)
    meta = F.to_json(F.struct("document_type", "execution_status", "vendor", "retention_category"))
    return one.select(*[_shown(c) for c in VIEW_FIELDS], meta.alias("metadata_json"),
                      F.col("text").alias("extracted_text"))


def filter_documents(
    df: DataFrame, status: str | None = None, document_type: str | None = None,
    vendor: str | None = None,
) -> DataFrame:
    """Equality on status and type, part of the vendor name; unknown states are ignored."""
    if status in fixed.DOCUMENT_STATUSES:
        df = df.where(F.col("status") == status)
    if document_type:
        df = df.where(F.col("document_type") == document_type)
    if vendor:
        df = df.where(F.col("vendor").ilike(f"%{vendor}%"))
    return df


def search_documents(df: DataFrame, query: str) -> DataFrame:
    """Query inside name, vendor or text; ``%`` and ``_`` in it act as wildcards."""
    like = f"%{query}%"
    return df.where(
        F.col("original_name").ilike(like) | F.col("vendor").ilike(like) | F.col("text").ilike(like)
    )


def list_documents(
    df: DataFrame, page: int = 1, per_page: int = 20, after: tuple | None = None
) -> DataFrame:
    """One page, newest first.

    ``after=(created_at, doc_id)`` of the last row seen continues without an offset,
    which is the way to walk deep into a large table.
    """
    if after is not None:
        seen_at, seen_id = (F.lit(v) for v in after)
        at = F.col("created_at")
        df = df.where((at < seen_at) | ((at == seen_at) & (F.col("doc_id") < seen_id)))
        return newest(df, "created_at", "doc_id").limit(per_page)
    return newest(df, "created_at", "doc_id").offset((page - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """Total and number of pages that belong to ``list_documents``."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / per_page).alias("pages"),
    )


def review_queue(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    return list_documents(df.where(F.col("review_status") == "needs_review"), page, per_page)


def recent_documents(df: DataFrame, n: int = 5) -> DataFrame:
    return list_documents(df, per_page=n)


def export_documents(
    df: DataFrame, status: str | None = None, document_type: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """The ten export columns, newest first."""
    df = filter_documents(df, status, document_type)
    if search:
        df = search_documents(df, search)
    return newest(df, "created_at", "doc_id").select(*[_shown(c) for c in _EXPORT])


def document_stats(df: DataFrame) -> DataFrame:
    """Total and counts by status, type, execution and review status in long form.

    The base table is read and counted once by all four columns; only that small
    result is unfolded.
    """
    cells = df.groupBy("status", "document_type", "execution_status", "review_status").agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = [("total", F.lit("all"))] + [
        (c, F.col(c)) for c in ("status", "document_type", "execution_status", "review_status")
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in pairs])
    return (
        cells.select(F.inline(entries), "n")
        .where(~F.col("dimension").isin("document_type", "execution_status") | F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.sum("n").alias("documents"))
    )


def dashboard_tiles(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def processing_summary(df: DataFrame) -> DataFrame:
    """Processed, failed and final counts with the share of final documents."""
    done = F.col("error").isNull()
    status = F.col("execution_status")
    counted = df.agg(
        F.count_if(done).alias("successful"),
        F.count_if(~done).alias("errors"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(done & (status == "final")).alias("final_documents"),
        F.count_if(done & (status == "supporting")).alias("supporting_documents"),
        F.count_if(done & ~F.coalesce(status, F.lit("")).isin("final", "supporting")).alias("other_documents"),
    )
    share = F.round(F.try_divide(100.0 * F.col("final_documents"), F.col("successful")), 1)
    return counted.withColumn("final_percent", share)


def vendor_counts(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("clean_vendor").agg(F.count(F.lit(1)).alias("documents"))
        .orderBy(F.col("documents").desc(), "clean_vendor")
    )


def vendor_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("clean_vendor", "document_type").agg(F.count(F.lit(1)).alias("documents"))


def violation_list(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules a row breaks."""
    named = F.array(*[F.when(broken, name) for name, broken in rules])
    return F.filter(named, lambda n: n.isNotNull())


def document_rules() -> list[tuple[str, Column]]:
    def outside(name, domain):
        return F.col(name).isNotNull() & (F.col(name) != "") & ~F.col(name).isin(*domain)

    return [
        ("Invalid document_type", outside("document_type", fixed.DOCUMENT_TYPES)),
        ("Invalid execution_status", outside("execution_status", fixed.EXECUTION_STATUSES)),
        ("Invalid retention_category", outside("retention_category", fixed.RETENTION_CATEGORIES)),
        ("review_notes is too long", F.length("review_notes") > fixed.MAX_REVIEW_NOTES),
        ("expiration_date cannot be before effective_date",
         F.col("expiration_date") < F.col("effective_date")),
    ]


def document_violations(df: DataFrame) -> DataFrame:
    """One row per document and broken rule."""
    return df.select("doc_id", F.explode(violation_list(document_rules())).alias("violation"))


def error_records(df: DataFrame) -> DataFrame:
    """Documents that could not be processed, with the reason."""
    return df.where(F.col("error").isNotNull()).select(
        F.col("path").alias("original_path"), F.col("error").alias("reason")
    )
