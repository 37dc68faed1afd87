"""Deadlines, expiry and retention reports; "now" is always a parameter."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.operators.documents import view_columns

_KINDS = ("expiration", "renewal", "review", "termination")


def deadlines(df: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Deadlines up to ``days`` ahead, overdue ones included.

    Each comes with the public fields of its document.  Only dates that are due become
    rows; the latest allowed day is checked, as a plain filter, already on the scan.
    """
    days = max(1, min(days, 3650))
    today = F.lit(as_of)
    last = F.date_add(today, days)
    any_due = reduce(lambda a, b: a | b, [F.col(f"{k}_date") <= last for k in _KINDS])
    dates = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_date").alias("due_date")) for k in _KINDS])
    due = F.filter(dates, lambda d: d["due_date"] <= last)
    long = df.where(any_due).select(*view_columns(df).values(), F.inline(due))
    left = F.datediff(F.col("due_date"), today)
    return long.withColumns({
        "days_remaining": left,
        "overdue": left < 0,
        "urgency": F.when(left < 0, "overdue").when(left <= 30, "soon").otherwise("later"),
    }).orderBy("due_date", "doc_id", "kind")


def tracked_date(value: Column) -> Column:
    """Time of an ISO text, null where it is none."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def _days_until(expires: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(expires) - F.unix_micros(now)) / 86400000000)


def expiring_documents(df: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Tracked documents that expire within ``months`` of 31 days."""
    now = F.lit(as_of).cast("timestamp")
    expires = tracked_date(F.col("expiration_date"))
    return (
        df.where(expires.between(now, now + F.make_dt_interval(days=F.lit(31 * months))))
        .withColumn("days_until_expiration", _days_until(expires, now))
        .orderBy("expiration_date", "tracking_id")
    )


def expiring_next_year(df: DataFrame, as_of) -> DataFrame:
    """Documents with 0 to 365 whole days left."""
    now = F.lit(as_of).cast("timestamp")
    left = _days_until(tracked_date(F.col("expiration_date")), now)
    return (
        df.withColumn("days_until_expiration", left)
        .where(F.col("days_until_expiration").between(0, 365))
        .orderBy("expiration_date", "tracking_id")
    )


def expiry_report(df: DataFrame, as_of) -> DataFrame:
    """Every tracked document with its days left and status."""
    now = F.lit(as_of).cast("timestamp")
    expires = tracked_date(F.col("expiration_date"))
    status = (
        F.when(expires.isNull(), "no_expiration")
        .when(expires < now, "expired")
        .when(expires <= now + F.make_dt_interval(days=F.lit(90)), "expiring_soon")
        .otherwise("active")
    )
    return df.withColumns({
        "days_until_expiration": _days_until(expires, now), "expiration_status": status,
    })


def by_retention_category(df: DataFrame, category: str | None = None) -> DataFrame:
    if not category:
        return df
    return df.where(F.lower(F.col("retention_category")) == category.lower())


def retention_counts(df: DataFrame) -> DataFrame:
    known = F.when(F.col("retention_category") != "", F.col("retention_category"))
    return (
        df.groupBy(F.coalesce(known, F.lit("unknown")).alias("retention_category"))
        .agg(F.count(F.lit(1)).alias("documents")).orderBy("retention_category")
    )
