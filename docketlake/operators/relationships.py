"""Links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake import fixed
from docketlake.operators.documents import view_columns


def related_documents(edges: DataFrame, docs: DataFrame, doc_id: int | None = None) -> DataFrame:
    """Every link seen from both of its ends, with the document at the other end.

    Two equi-joins instead of one on "either end".  A document that very many
    links point to is a skewed key of the link side only, which adaptive execution
    splits; documents are unique on the other side.  For one document
    (``doc_id``) each related one comes with all its public fields, as the struct
    ``related_document``.
    """
    full = [F.struct(*view_columns(docs).values()).alias("related_document")] if doc_id is not None else []
    docs = docs.select(
        F.col("doc_id").alias("related_id"), F.col("tenant_id").alias("related_tenant"),
        "original_name", "document_type", "status", *full,
    )
    seen = []
    for own, other, direction in (
        ("source_document_id", "target_document_id", "outgoing"),
        ("target_document_id", "source_document_id", "incoming"),
    ):
        side = edges if doc_id is None else edges.where(F.col(own) == doc_id)
        if direction == "incoming":
            side = side.where(F.col(own) != F.col(other))
        seen.append(side.select(
            "relationship_id", "relationship_type", "tenant_id", "created_at", "created_by_id",
            F.lit(direction).alias("direction"),
            F.col(own).alias("document_id"), F.col(other).alias("related_id"),
        ))
    links = seen[0].unionByName(seen[1])
    joined = links.join(docs, "related_id").where(F.col("tenant_id").eqNullSafe(F.col("related_tenant")))
    return joined.drop("related_tenant").orderBy("created_at", "relationship_id", "direction")


def relationship_violations(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Broken rules per link: self link, unknown type, unseen target, repeated pair."""
    known = docs.select(F.col("doc_id").alias("target_document_id"), F.col("tenant_id").alias("_tenant"))
    # one row per document, so the left join adds no rows
    joined = edges.join(known.withColumn("_known", F.lit(True)), "target_document_id", "left")
    own = F.coalesce("_known", F.lit(False)) & F.col("tenant_id").eqNullSafe(F.col("_tenant"))
    kind = F.coalesce("relationship_type", F.lit(""))
    rules = F.array(
        F.when(F.col("source_document_id") == F.col("target_document_id"), "self_link"),
        F.when(~kind.isin(*fixed.RELATIONSHIP_TYPES), "invalid_type"),
        F.when(~own, "target_not_found"),
    )
    single = joined.select(
        "relationship_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation")
    )
    # the first link of a pair stays; its later repeats break the pair's uniqueness
    pairs = edges.groupBy("source_document_id", "target_document_id").agg(
        F.min("relationship_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1")
    repeated = edges.join(pairs, ["source_document_id", "target_document_id"]).where(
        "relationship_id <> _first"
    ).select("relationship_id", F.lit("duplicate_pair").alias("violation"))
    return single.unionByName(repeated)


def cascade_edges(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Links whose documents both still exist."""
    ids = docs.select("doc_id")
    for end in ("source_document_id", "target_document_id"):
        edges = edges.join(ids, edges[end] == ids["doc_id"], "left_semi")
    return edges
