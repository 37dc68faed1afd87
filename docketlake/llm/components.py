"""Connected components by alternating large and small stars, on joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import stage


def _lower_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lower_neighbour(both).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = _lower_neighbour(links)
    moved = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.withColumnRenamed("low", "b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Every node that is not a root has one link, and that leads to a root."""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("down")
    ends = links.select(F.col("a").alias("node"), up, down).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, root of every node in ``links`` (a, b); the root is the smallest node of its component.

    Every round is written to the shared folder, so lineage stays short.  The
    number of rounds grows with the logarithm of the longest path.
    """
    ends = stage(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _settled(ends):
        ends = stage(_small_star(_large_star(ends)), name)
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        ends.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
