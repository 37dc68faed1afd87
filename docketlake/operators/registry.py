"""The tracking registry: totals, retention counts and the expiration list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NO_DATE = "9999-12-31"


def registry_totals(df: DataFrame) -> DataFrame:
    """One row: documents and how many of them expire."""
    return df.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count(F.nullif("expiration_date", F.lit(""))).alias("documents_with_expiration"),
    )


def registry_rollup(df: DataFrame) -> DataFrame:
    """Totals per retention category, the registry's counters in long form."""
    return df.groupBy(F.coalesce("retention_category", F.lit("unknown")).alias("retention_category")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.nullif("expiration_date", F.lit(""))).alias("documents_with_expiration"),
    )


def expiration_tracking(df: DataFrame) -> DataFrame:
    """Documents with an expiration date, soonest first.

    It stays a table: the list of a large archive does not fit one JSON value.
    """
    return df.where(F.col("expiration_date").isNotNull()).orderBy(
        F.coalesce("expiration_date", F.lit(NO_DATE)), "tracking_id"
    )
