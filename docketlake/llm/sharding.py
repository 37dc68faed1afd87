"""Sharding by longest-processing-time scheduling of groups that stay together.

Groups (here: equal texts) are placed in falling order of size, each on the
shard with the least load, which a heap gives.  A group that holds more than a
fixed part of all bytes is placed by itself; there can be only so many of them.
The others are first packed into a fixed number of parcels by their digest, and
the parcels are placed like groups.  So the heap handles a bounded number of
items at every input size, and with few documents every group is its own item.

Rows: a null text has no bytes and size 1; null texts form one group, empty
texts another.  Repeated rows are rows of their own in one group.  Every shard
numbers its rows from 0 without gaps, in an order given by a hash of the row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F, Window

from docketlake.llm.common import stage

SHARDS = 16
# A group of more than 1 / LARGE of all bytes is placed by itself; the rest in PARCELS parcels.
LARGE, PARCELS = 16_384, 16_384
# Rows that one task numbers at a time, on average.
ROWS_PER_SLICE = 4_000


def schedule(sizes: dict, shards: int) -> dict:
    """Longest first, each to the least-loaded shard; ties by name and by shard number."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[name] = shard
    return placed


def assign_shards(rows: DataFrame, shards: int = SHARDS, large: int = LARGE, parcels: int = PARCELS) -> DataFrame:
    """Add ``shard`` to rows that have ``group`` (string, not null) and ``size`` (long)."""
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    by_itself = F.col("group_size") * large > total
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels))
    # at most `large` groups pass the test and there are `parcels` parcels: bounded
    items = groups.groupBy(
        F.when(by_itself, F.col("group")).otherwise(F.concat(F.lit("/"), parcel.cast("string"))).alias("item"),
    ).agg(F.sum("group_size").alias("item_size"))
    placed = schedule({r.item: r.item_size for r in items.collect()}, shards)
    place = spark.createDataFrame(list(placed.items()), "item string, shard int")
    alone = place.where("item not like '/%'").select(F.col("item").alias("group"), F.col("shard").alias("own_shard"))
    packed = place.where("item like '/%'").select(
        F.substring("item", 2, 20).cast("long").alias("parcel"), F.col("shard").alias("parcel_shard"))
    return rows.withColumn("parcel", parcel).join(F.broadcast(alone), "group", "left").join(
        F.broadcast(packed), "parcel", "left").withColumn(
        "shard", F.coalesce("own_shard", "parcel_shard")).drop("parcel", "own_shard", "parcel_shard")


def number_slots(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... in each shard, for any number of rows.

    Rows are cut into slices by a hash; slices are counted, the counts are
    summed up in front of each slice, and rows are numbered inside their slice.
    """
    count = rows.count()
    slices = count // (ROWS_PER_SLICE * shards) + 1
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slices)))
    before = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32"))
    return sliced.withColumn("inside", inside).join(before, ["shard", "slice"]).withColumn(
        "slot", F.col("before") + F.col("inside") - 1).drop("slice", "inside", "before")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard."""
    rows = stage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("null")).alias("group"),
    ), "shard-rows")
    return number_slots(assign_shards(rows, shards), shards).select("doc_id", "size", "text_crc32", "shard", "slot")
