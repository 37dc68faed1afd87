"""Numbers, names and target paths of filed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions.naming import enhanced_filename, route_folder, simple_filename
from docketlake.functions.text import file_extension, without_extension
from docketlake.operators.ordered import in_slices, rank_in_groups, running_total, total_in_slices
from docketlake.session import staged

_VENDOR_TYPE = ["clean_vendor", "document_type"]
# What names and places are made of; other columns of a document are only carried along.
_NAMED = ("path", "folder", "original_name", *_VENDOR_TYPE, "execution_status", "date_str")


def assign_sequence_ids(df: DataFrame, order: str = "path") -> DataFrame:
    """Running number per vendor and type, in ``order``; safe for very large vendors."""
    return rank_in_groups(df, _VENDOR_TYPE, [order], "sequence_id")


def _numbered(target: Column, suffix: str, number: Column) -> Column:
    return F.concat(
        without_extension(target), F.format_string(f"{suffix}%02d", number), file_extension(target)
    )


def _reserved_numbers(names: DataFrame, target: str, suffix: str) -> DataFrame:
    """Numbers that names in use already take, per name without its number."""
    names = names.where(F.col(target).contains(suffix))  # plain text before the pattern
    stem = without_extension(F.col(target))
    pattern = rf"^(.+){suffix}(\d{{2,9}})$"
    digits = F.regexp_extract(stem, pattern, 2)
    found = names.where(stem.rlike(pattern)).select(
        F.concat(F.regexp_extract(stem, pattern, 1), file_extension(F.col(target))).alias(target),
        digits.cast("long").alias("_number"), digits.alias("_digits"),
    )
    canonical = (F.col("_number") >= 1) & (F.format_string("%02d", F.col("_number")) == F.col("_digits"))
    return found.where(canonical).select(target, "_number").distinct()


def _given_paths(
    asked: DataFrame, target: str, order: str, existing: DataFrame | None, suffix: str, out: str,
) -> DataFrame:
    """``asked`` (``_row``, target, order and perhaps more) with a path of its own for every row.

    The first row that asks for a free path keeps it; the next ones get the lowest
    numbers no existing or requested path holds.  The k-th free number is k plus the
    taken numbers below it, found with one running total over requests and taken
    numbers together.  Only these narrow rows are ranked.
    """
    order = [order, "_row"]
    sliced = in_slices(asked, [target], order)
    ranked = total_in_slices(sliced, [target], order, F.lit(1).cast("long"), "_rank").drop("_slice").withColumn(
        "_copy", F.col("_rank") - 1)
    numbered = F.col("_copy")
    names = sliced.select(target)
    if existing is not None:
        held = existing.select(F.col(existing.columns[0]).alias(target)).distinct()
        names = names.union(held)
        ranked = ranked.join(held.withColumn("_held", F.lit(1)), target, "left").withColumn(
            "_copy", F.col("_copy") + F.coalesce("_held", F.lit(0))).drop("_held")
    reserved = staged(_reserved_numbers(names, target, suffix), "reserved")
    if not reserved.isEmpty():
        taken = rank_in_groups(reserved, [target], ["_number"], "_place")
        # several taken numbers can share one position; they only add up
        blocks = taken.groupBy(target, (F.col("_number") - F.col("_place")).alias("_copy")).agg(
            F.count(F.lit(1)).alias("_add")).withColumn("_kind", F.lit(1))
        requests = ranked.withColumns({"_kind": F.lit(0), "_add": F.lit(0).cast("long")})
        ranked = running_total(
            requests.unionByName(blocks, allowMissingColumns=True), [target], ["_copy", "_kind", "_row"], F.col("_add"), "_skip",
        ).where("_kind = 0")
        numbered = F.col("_copy") + F.col("_skip")
    return ranked.withColumn(out, F.when(F.col("_copy") == 0, F.col(target)).otherwise(
        _numbered(F.col(target), suffix, numbered))).select(*asked.columns, out)


def resolve_conflicts(
    df: DataFrame,
    target: str = "target_path",
    order: str = "path",
    existing: DataFrame | None = None,
    suffix: str = "_conflict",
    out: str = "resolved_path",
) -> DataFrame:
    """Give every row a path of its own; rows ask in ``order``.

    The rows are written once; ranks are found on (target, order) alone and join
    their rows again by number.
    """
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    given = _given_paths(rows.select("_row", target, order), target, order, existing, suffix, out)
    return rows.join(given.select("_row", out), "_row").drop("_row")


def unique_names(df: DataFrame, target: str = "target_path", order: str = "path",
                 existing: DataFrame | None = None, out: str = "resolved_path") -> DataFrame:
    """Like ``resolve_conflicts`` with a bare ``_01``."""
    return resolve_conflicts(df, target, order, existing, "_", out)


def naming_plan(
    docs: DataFrame, naming: str = "enhanced", existing: DataFrame | None = None,
    subfolders: bool = True,
) -> DataFrame:
    """Number, new name, folder and conflict-free path of every analysed document.

    ``docs``: path, folder, original_name, clean_vendor, document_type,
    execution_status, date_str.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    read = [c for c in _NAMED if c in docs.columns]
    numbered = rank_in_groups(rows.select("_row", *read), _VENDOR_TYPE, ["path", "_row"], "sequence_id")
    if naming == "enhanced":
        name = enhanced_filename(
            F.col("clean_vendor"), F.col("document_type"), F.col("original_name"), F.col("sequence_id")
        )
    else:
        name = simple_filename(F.col("clean_vendor"), F.col("original_name"), F.col("date_str"))
    base = F.col("folder")
    place = F.concat_ws("/", base, route_folder(base, F.col("execution_status"))) if subfolders else base
    asked = numbered.withColumn("new_filename", name).withColumn(
        "target_path", F.concat_ws("/", place, F.col("new_filename"))
    ).select("_row", "path", "sequence_id", "new_filename", "target_path")
    given = _given_paths(staged(asked, "asked"), "target_path", "path", existing, "_conflict", "resolved_path")
    return rows.join(given.drop("path"), "_row").drop("_row")
