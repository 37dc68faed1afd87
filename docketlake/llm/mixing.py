"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked in turn to the
target shares of sources, languages and topics until all three hold to
TOLERANCE.  Sweeps end early only where the targets contradict each other, for
a cell missing from the corpus cannot be filled: when a sweep no longer brings
them nearer, or after MOST_SWEEPS, a warning names what is missed.  A cell's
raked weight over its tokens, times one factor for all, is the rate at which its
documents are drawn, 1 at most.  The factor is the one at which SHARE of all
tokens are expected to be drawn; cells too small for their weight are taken
whole.  A document is drawn if a hash of its id falls below its rate.
Everything is DataFrame and SQL functions.

The topic of a document is the form of its content (``topic_of``).  Without
given targets a marginal's shares are the square roots of its token shares,
scaled to one, which lifts the small ones.

Rows: null sources and languages are values of their own.  A document without
words has no weight in the fitting and is drawn like the others of its cell; a
cell without any tokens has rate 1.  A value that the targets do not name gets
nothing.  Repeated rows are drawn together; a null doc_id is hashed as ''.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, Window

from docketlake.llm.common import spare, stage

MARGINALS = ("source", "lang", "topic")
# The part of all tokens that is drawn.
SHARE = 0.5
# Token shares of a marginal may differ from their targets by so much in all; a sweep that takes off less than SLOW
# of what is missed is no progress.
TOLERANCE, MOST_SWEEPS, SLOW = 1e-10, 200, 1e-3
# Cells that one task scales.
CELLS_PER_TASK = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The form of the content: listing, shouting, symbols, licensed or prose; the first that fits."""
    return (
        F.when(text.contains(" | "), "listing").when(text.contains("!! "), "shouting")
        .when(text.contains("$$$") | text.contains("***"), "symbols")
        .when(text.contains("licensed under") | text.contains("All rights reserved"), "licensed").otherwise("prose")
    )


def uniform(seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the doc_id and the seed."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(16**12)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the three marginals and n_tokens of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", "lang",
        topic_of(text).alias("topic"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"))


def default_target(cells: DataFrame, marginal: str) -> DataFrame:
    """The marginal's values and their target shares: square roots of the token shares."""
    each = cells.groupBy(marginal).agg(F.sqrt(F.sum("tokens")).alias("root"))
    every = each.agg(F.sum("root")).first()[0] or 1.0
    return each.select(marginal, (F.col("root") / F.lit(every)).alias("share"))


def joined_by(left: DataFrame, right: DataFrame, names: dict[str, str], how: str = "left") -> DataFrame:
    """Join on equal values, nulls included; ``names`` maps the columns of ``left`` to those of ``right``, which go."""
    other = {name: f"{name}_of_right" for name in names.values()}
    renamed = right.withColumnsRenamed(other)
    same = reduce(and_, [left[one].eqNullSafe(renamed[other[two]]) for one, two in names.items()])
    return left.join(renamed, same, how).drop(*other.values())


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Add ``weight`` to cells (source, lang, topic, tokens): token shares that meet the targets.

    The shares are joined once; a scaling then is one window over the marginal, which also
    shows how far the marginal was off.  Every sweep is written to a table, so plans and
    lineage stay short.
    """
    aims, gaps = [f"aim_{m}" for m in MARGINALS], [f"gap_{m}" for m in MARGINALS]
    for marginal, aim in zip(MARGINALS, aims):
        cells = joined_by(cells, targets[marginal].withColumnRenamed("share", aim), {marginal: marginal})
        cells = cells.withColumn(aim, F.coalesce(aim, F.lit(0.0)))
    cells = stage(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    before = math.inf
    for _ in range(MOST_SWEEPS):
        cells = together(cells)
        for marginal, aim, gap in zip(MARGINALS, aims, gaps):
            held = F.sum("weight").over(Window.partitionBy(marginal))
            cells = cells.withColumn("held", held).withColumn(gap, F.abs(F.col("held") - F.col(aim))).withColumn(
                "weight", F.when(F.col("held") > 0, F.col("weight") * F.col(aim) / F.col("held")).otherwise(0.0))
        cells = stage(cells.drop("held"), "cells")
        missed = cells.agg(*[F.max(g).alias(m) for m, g in zip(MARGINALS, gaps)]).first().asDict()
        widest = max((v for v in missed.values() if v is not None), default=0.0)
        if widest <= TOLERANCE:
            break
        if widest > before * (1 - SLOW):
            warnings.warn(f"targets contradict each other or the corpus; largest misses {missed}", stacklevel=2)
            break
        before = widest
    return cells.drop(*aims, *gaps)


def together(cells: DataFrame) -> DataFrame:
    """Cells in tasks of CELLS_PER_TASK: the few that most corpora have then need no shuffle."""
    return cells.coalesce(int(cells.count() // CELLS_PER_TASK) + 1)


def factor_for(cells: DataFrame, wanted: float) -> float:
    """The factor at which the rates min(1, factor * ratio) draw ``wanted`` tokens.

    Starts without any cell taken whole; each step takes those whole whose rate
    passes 1 and spreads what is still wanted over the others, until none is new.
    """
    factor = 0.0
    while True:
        whole = F.col("ratio") * F.lit(factor) >= 1
        taken, rest = cells.agg(
            F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))).first()
        if not rest:
            return factor
        after = (wanted - (taken or 0)) / rest
        if after <= factor:
            return factor
        factor = after


def rates(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 0,
          share: float = SHARE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (raked share of the cell), rate, drawn of every row.

    ``targets`` names a marginal's values and shares; the others get the default.
    """
    rows = stage(measured(docs), "measured")
    cells = together(stage(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "tokens"))
    aims = {m: stage((targets or {}).get(m, default_target(cells, m)), "targets") for m in MARGINALS}
    filled = together(rake(cells.where("tokens > 0"), aims)).withColumn("ratio", F.col("weight") / F.col("tokens"))
    every = filled.agg(F.sum("tokens")).first()[0] or 0
    factor = factor_for(filled, share * every)
    rated = filled.select(*MARGINALS, "weight", F.least(F.lit(1.0), F.col("ratio") * F.lit(factor)).alias("rate"))
    return joined_by(rows, rated, {m: m for m in MARGINALS}).select(
        "doc_id", *MARGINALS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("rate", F.lit(1.0)).alias("rate"),
    ).withColumn("drawn", uniform(seed) < F.col("rate"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    cell_rates = stage(rates(docs, targets, seed).groupBy(*MARGINALS).agg(F.max("rate").alias("rate")), "rates")
    topic, rate = spare(docs, "mix_topic", "mix_rate")
    keyed = docs.withColumn(topic, topic_of(F.coalesce("text", F.lit(""))))
    rated = cell_rates.withColumnRenamed("rate", rate)
    return joined_by(keyed, rated, {"source": "source", "lang": "lang", topic: "topic"}, "inner").where(
        uniform(seed) < F.col(rate)).select(*docs.columns)
