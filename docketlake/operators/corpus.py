"""Labelled examples for the text model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake import fixed
from docketlake.functions.doctype import document_type
from docketlake.functions.replies import training_target, truncate_prompt
from docketlake.functions.text import first_filled, strip
from docketlake.functions.vendors import vendor_from_filename, vendor_from_folder
from docketlake.operators.ordered import rank_in_groups
from docketlake.session import staged


def pseudo_labels(
    docs: DataFrame, exclude_defaults: bool = False, vendor_source: str = "any",
    answers: bool = False,
) -> DataFrame:
    """Text, type, vendor and source of every document with text.

    With ``answers`` the labels come from the ``answer`` struct of a model instead
    of the rules.
    """
    docs = docs.where(F.coalesce("text", F.lit("")) != "")
    if answers:
        kind = F.upper(strip(F.coalesce("answer.doc_type", F.lit(""))))
        labelled = docs.withColumn("doc_type", kind).withColumn(
            "vendor", strip(F.coalesce("answer.vendor", F.lit("")))
        ).where("doc_type <> ''").withColumn("is_default", F.lit(False))
    else:
        labelled = docs.withColumn("doc_type", document_type(F.col("text"), F.col("original_name"))).withColumn(
            "vendor",
            first_filled(vendor_from_folder(F.col("folder")), vendor_from_filename(F.col("original_name"))),
        ).withColumn("is_default", F.col("doc_type") == fixed.DEFAULT_TYPE)
    if exclude_defaults:
        labelled = labelled.where("not is_default")
    if vendor_source != "any":
        labelled = labelled.where("vendor <> ''")
    return labelled.select(
        "doc_id", "text", "doc_type", "vendor", "is_default",
        F.lit("lm" if answers else "regex").alias("source"),
    )


def training_pairs(labels: DataFrame) -> DataFrame:
    """Prompt and target per label with text."""
    text = strip(F.coalesce("text", F.lit("")))
    kind = F.upper(strip(F.coalesce("doc_type", F.lit(""))))
    return labels.where(text != "").select(
        "doc_id",
        truncate_prompt(text).alias("prompt"),
        training_target(
            F.when(kind == "", fixed.DEFAULT_TYPE).otherwise(kind),
            strip(F.coalesce("vendor", F.lit(""))),
        ).alias("target"),
    )


def train_eval_split(examples: DataFrame, order: str = "doc_id", eval_ratio: float = 0.1) -> DataFrame:
    """Add ``split``: the leading share is for training, fewer than ten rows all are."""
    rows = staged(examples.withColumn("_row", F.monotonically_increasing_id()), "examples")
    total = rows.count()
    last = total if total < 10 else max(1, int(total * (1 - eval_ratio)))
    # only (order, row) is ranked; the texts join their rank by number
    ranked = rank_in_groups(rows.select(F.col(order).alias("_at"), "_row"), [], ["_at", "_row"], "_rank")
    split = F.when(F.col("_rank") <= last, "train").otherwise("eval").alias("split")
    return rows.join(ranked.select("_row", split), "_row").drop("_row")
