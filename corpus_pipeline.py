"""A training corpus from raw documents: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketlake.llm import decontamination, mixing, near_dedup, quality, sharding
from docketlake.llm.common import prepare, stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labels of documents in ``docs``."""
    prepare(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle sets of a similarity of 0.8 or more, the one with the smallest doc_id."""
    prepare(spark)
    return near_dedup.near_dedup(docs, percent=80)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the contamination limit, unchanged."""
    prepare(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares."""
    prepare(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document left."""
    prepare(spark)
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", not_in_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# The classifier is learned, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
