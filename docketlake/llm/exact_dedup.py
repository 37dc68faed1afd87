"""Exact deduplication with salted combining, so that no group of copies is hot.

Equal texts meet in three steps: inside each task (the partial aggregate before
the shuffle), in salted digest groups, and over the salt winners.  Every step
groups by the digest and by the full normalised text, so a digest that two
different texts share never merges them.

Rows: a null text counts as empty.  Of equal texts the row with the most code
points stays, then the smallest doc_id; a null doc_id comes after all others.
Repeated rows are counted one by one and share one decision.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.llm.common import spare, stage

# Number of salts a group of copies is spread over.
SALTS = 32
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), WHITE_SPACE, F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best() -> Column:
    """Sorts the row that stays first."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"),
                    F.col("doc_id").alias("id"))


def find_copies(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, digest, keep_id, keep_points, group_size, kept: one row per row of ``docs``.

    ``digest`` maps the normalised text to the key rows are dealt by.  Texts
    that share a digest are told apart by their content: only for such digests
    does the last join compare texts again.
    """
    text = docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("content"),
    ).withColumn("digest", digest(F.col("content")))
    salted = text.groupBy(
        F.pmod(F.xxhash64("doc_id", "points"), F.lit(salts)).alias("salt"), "digest", "content",
    ).agg(F.count(F.lit(1)).alias("size"), F.min(_best()).alias("best"))
    winners = salted.groupBy("digest", "content").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    by_digest = stage(winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.first("size").alias("size"), F.first("best").alias("best"),
    ), "digests")
    members = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), "text")
    single = by_digest.where("contents = 1").drop("contents")
    found = members.drop("text").join(single, "digest")
    shared = by_digest.where("contents > 1").select("digest")
    if not shared.isEmpty():
        # texts that share a digest with another text: join on the content as well
        found = found.unionByName(members.join(shared, "digest", "left_semi").withColumn(
            "content", normalised(F.col("text"))).drop("text").join(winners, ["digest", "content"]).drop("content"))
    return found.select(
        "doc_id", "digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one."""
    digest, points, kept_id, kept_digest, kept_points = spare(
        docs, "digest", "points", "kept_id", "kept_digest", "kept_points")
    kept = find_copies(docs, salts=salts).where("kept").select("doc_id", "digest", "keep_points").distinct().toDF(
        kept_id, kept_digest, kept_points)
    keyed = docs.withColumns({
        digest: sha256(normalised(F.col("text"))), points: F.length(F.coalesce("text", F.lit("")))})
    return keyed.join(
        kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
        & (F.col(points) == F.col(kept_points)), "left_semi",
    ).dropDuplicates(["doc_id", digest]).select(*docs.columns)
