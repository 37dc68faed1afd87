"""Ranks and running totals inside groups of any size.

A plain window sends a whole group to one task.  Here rows are dealt to range
partitions of their keys and their whole order and written with the number of
their partition, the slice.  A group that holds a third of all rows, or all of
them, then lies in many slices, as do rows that only differ in the last column
of the order.  A window inside (keys, slice) does most of the work.  Only the
first group of a slice can have begun before it, so one number for each slice
brings its rows up to the whole total.  There is one plan for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake.session import staged

# Number of slices; None leaves it to spark.sql.shuffle.partitions and the sizes Spark measures.
SLICES: int | None = None


def in_slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_slice``: slices follow each other by ``keys``, then ``order``, nulls first.

    Borders differ from run to run, so the rows are written once with their slice.
    Callers pass few columns: the rows travel once more when they are ranked.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(*([SLICES] if SLICES else []), *columns)
    return staged(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _bounds(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """First and last group of every slice: one row for each."""
    return sliced.groupBy("_slice").agg(F.min(_key(keys)).alias("_first"), F.max(_key(keys)).alias("_last"))


def total_in_slices(sliced: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``running_total`` of rows that are in slices of ``keys`` and ``order`` already."""
    rows = sliced.withColumn("_value", value)
    bounds = _bounds(sliced, keys)
    # what a slice adds to its last group, and the requests of slices for what their first group has before them
    tails = rows.join(F.broadcast(bounds), "_slice").where(_key(keys).eqNullSafe(F.col("_last"))).groupBy("_slice").agg(
        F.first("_last").alias("_group"), F.sum("_value").alias("_add"))
    asked = bounds.select(F.col("_slice"), F.col("_first").alias("_group"), F.lit(None).alias("_add"))
    both = tails.withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)))
    before = W.partitionBy("_group").orderBy("_slice", F.col("_asks").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = both.withColumn("_start", F.sum("_add").over(before)).where("_asks = 1 and _start is not null").select(
        F.col("_slice").alias("_of_slice"), F.col("_group").alias("_of_group"), "_start")
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # one row for each slice at most
    return rows.withColumn("_inside", F.sum("_value").over(inside)).join(
        F.broadcast(starts), (F.col("_slice") == F.col("_of_slice")) & _key(keys).eqNullSafe(F.col("_of_group")), "left",
    ).withColumn(out, F.col("_inside") + F.coalesce("_start", F.lit(0))).select(*sliced.columns, out)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """``sum(value) over (partition by keys order by order)``, rows up to the current one.

    Null keys form a group of their own.  Rows equal in the whole order share no
    fixed sequence, so ``order`` should end in a unique column.
    """
    return total_in_slices(in_slices(df, keys, order), keys, order, value, out).drop("_slice")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number()`` within groups of any size."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out)


def previous_in_groups(sliced: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` of rows in slices of ``keys`` and ``order``.

    ``value`` is the first column of ``order``, so the last row of a slice has its largest.
    """
    ends = sliced.groupBy("_slice").agg(
        F.min(_key(keys)).alias("_first"), F.max(F.struct(_key(keys).alias("group"), F.col(value).alias("value"))).alias("_end"))
    neighbours = ends.withColumn("_left", F.lag("_end").over(W.partitionBy(F.lit(0)).orderBy("_slice"))).where(
        F.col("_left.group").eqNullSafe(F.col("_first"))).select(
        F.col("_slice").alias("_of_slice"), F.col("_first").alias("_of_group"), F.col("_left.value").alias("_before"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return sliced.withColumn("_inside", F.lag(value).over(inside)).join(
        F.broadcast(neighbours), (F.col("_slice") == F.col("_of_slice")) & _key(keys).eqNullSafe(F.col("_of_group")), "left",
    ).withColumn(out, F.coalesce("_inside", "_before")).select(*sliced.columns, out)


def newest(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc())


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "_rank") -> DataFrame:
    """The first ``n`` rows of every group.

    The rank is compared with a constant, so Spark keeps only ``n`` rows per group
    and task before the shuffle (WindowGroupLimit).
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= n)
