"""Request rates per client: trailing counts and the sliding limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake import fixed
from docketlake.operators.ordered import in_slices, previous_in_groups, running_total, total_in_slices
from docketlake.session import staged

def rolling_event_counts(events: DataFrame, seconds: int = fixed.RATE_WINDOW_SECONDS) -> DataFrame:
    """Events of a client in the ``seconds`` up to and including each event time.

    Equal times are counted together first.  A count enters at its time and leaves
    ``seconds`` later, so what counts at a time is one running total of both, however
    many events lie in a window; even one very busy client is spread over many tasks.
    """
    counted = events.where("seen_at is not null").groupBy("client", "seen_at").agg(F.count(F.lit(1)).alias("n"))
    at = F.unix_micros("seen_at")
    moves = F.array(  # at one time, what leaves goes before what enters
        F.struct((at + seconds * 1000000).alias("_at"), F.lit(0).alias("_enters"), (-F.col("n")).alias("_step")),
        F.struct(at.alias("_at"), F.lit(1).alias("_enters"), F.col("n").alias("_step")))
    moved = counted.select("client", "seen_at", "n", F.inline(moves))
    total = running_total(moved, ["client"], ["_at", "_enters"], F.col("_step"), "trailing_count")
    return total.where("_enters = 1").select("client", "seen_at", "n", "trailing_count")


def quiet_islands(
    events: DataFrame, keys: list[str], time: str, unique: str, gap_seconds: int
) -> DataFrame:
    """Number runs of events without a pause of ``gap_seconds`` (column ``island``); ``_slice`` stays, see ``ordered``."""
    order = [time, unique]
    sliced = in_slices(events, keys, order)
    pause = F.unix_micros(time) - F.unix_micros("_previous")
    starts = F.coalesce((pause >= gap_seconds * 1000000).cast("long"), F.lit(1).cast("long"))
    marked = staged(previous_in_groups(sliced, keys, order, time, "_previous").withColumn("_starts", starts).drop("_previous"))
    return total_in_slices(marked, keys, order, F.col("_starts"), "island").drop("_starts")


_RUN = ["bucket", "client", "island"]
_PART = [*_RUN, "_slice"]
# Rounds in which slices of a run are decided side by side before the rest is decided in order.
ROUNDS = 6


def _decided(rows: DataFrame, unit: list[str], window_us: int) -> DataFrame:
    """Refused requests of every unit of work, and one row without request that ends it.

    ``rows``: run, _slice, request_id, _us, limit and entry, the accepted times a unit
    starts from.  The last row of a unit holds its first time, the entry and the times
    it leaves behind.  A unit streams through its task; in memory are as many accepted
    times as the limit, as a refused request does not count later on.
    """
    kept = ["request_id", "bucket", "client", "island", "_slice", "_us"]
    id_type = rows.schema["request_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted, head = None, deque(), None

        def end() -> pd.DataFrame:
            return pd.DataFrame([{**head, "exit": list(accepted)}])

        for batch in batches:
            refused = []
            keys = zip(*(batch[c].tolist() for c in unit))
            for i, (key, now, limit) in enumerate(zip(keys, batch["_us"].tolist(), batch["limit"].tolist())):
                if key != current:
                    if current is not None:
                        yield end()
                    entry = [] if batch["entry"].iat[i] is None else [int(t) for t in batch["entry"].iat[i]]
                    current, accepted = key, deque(entry)
                    head = {c: batch[c].iat[i] for c in _PART} | {"first": now, "entry": entry}
                while accepted and now - accepted[0] >= window_us:
                    accepted.popleft()
                full = len(accepted) >= limit
                refused.append(full)
                if not full:
                    accepted.append(now)
            yield batch.loc[refused, kept].assign(first=None, entry=None, exit=None)
        if current is not None:
            yield end().assign(request_id=None)

    def columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in work(frames):
            yield frame.reindex(columns=[*kept, "first", "entry", "exit"])

    ordered = rows.repartition(*unit).sortWithinPartitions(*unit, "_us", "request_id")
    return ordered.mapInPandas(columns, (
        f"request_id {id_type}, bucket string, client string, island long, _slice int, _us long, "
        "first long, entry array<long>, exit array<long>"))


def _changed(ends: DataFrame, window_us: int) -> DataFrame:
    """Slices of a run whose start is not what the slice before leaves behind: the part and its right entry.

    ``ends`` has few rows: a slice belongs to several runs, but only its first one has begun before.
    """
    before = F.coalesce(F.lag("exit").over(W.partitionBy(*_RUN).orderBy("_slice")), F.array().cast("array<long>"))
    right = F.filter(before, lambda t: F.col("first") - t < window_us)
    return ends.withColumn("_right", right).where(F.col("_right") != F.col("entry")).select(
        *_PART, F.col("_right").alias("entry"))


def limit_of(bucket: Column, limits: dict[str, int]) -> Column:
    """Limit of a bucket; 0 means unlimited."""
    out = F.lit(0)
    for name, value in limits.items():
        out = F.when(bucket == name, value).otherwise(out)
    return out


def sliding_rate_violations(
    requests: DataFrame, limits: dict[str, int] = fixed.RATE_LIMITS,
    seconds: int = fixed.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Requests over the limit of their client in the trailing window.

    After a pause as long as the window nothing earlier counts any more, so runs
    between pauses are independent.  Runs with no more requests than the limit
    cannot hold a refusal and never leave the JVM.  A run of any length is decided
    slice by slice in all tasks at once, each slice as if nothing had been accepted
    before it; then those slices are decided again whose start turns out to differ
    from what the slice before has left, until there are none.  Under steady
    pressure the difference can wander on from slice to slice: what is open after
    ROUNDS is decided in order, in one task for each such run and in constant memory.
    Requests without a client count as one client, "unknown".
    """
    window_us, keys = seconds * 1000000, ["bucket", "client"]
    limited = requests.withColumn("client", F.coalesce("client", F.lit(fixed.UNKNOWN_CLIENT))).select(
        "request_id", *keys, "seen_at", limit_of(F.col("bucket"), limits).alias("limit"))
    numbered = staged(quiet_islands(limited.where("limit > 0"), keys, "seen_at", "request_id", seconds), "runs").withColumn(
        "_us", F.unix_micros("seen_at")).drop("seen_at")
    busy = numbered.groupBy(*_RUN, "limit").agg(F.count(F.lit(1)).alias("n")).where("n > limit").select(*_RUN)
    work = staged(numbered.join(busy, _RUN, "left_semi"), "busy")
    nothing = F.array().cast("array<long>")
    done = [staged(_decided(work.withColumn("entry", nothing), _PART, window_us), "decided")]
    several = done[0].where("request_id is null").groupBy(*_RUN).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_RUN)
    ends = staged(done[0].where("request_id is null").join(several, _RUN, "left_semi").select(*_PART, "first", "entry", "exit"), "ends")
    rest = None
    for turn in range(ROUNDS):
        changed = staged(_changed(ends, window_us), "changed")
        if changed.isEmpty():
            break
        if turn < ROUNDS - 1:
            again = work.join(changed, _PART)
            done.append(staged(_decided(again, _PART, window_us), "decided"))
            new = done[-1].where("request_id is null").select(*_PART, "first", "entry", "exit")
            ends = staged(ends.join(changed, _PART, "left_anti").unionByName(new), "ends")
        else:
            since = changed.groupBy(*_RUN).agg(F.min(F.struct("_slice", "entry")).alias("_from"))
            rest = work.join(since, _RUN).where("_slice >= _from._slice").withColumn("entry", F.col("_from.entry")).drop("_from")
    refused = done[0]
    for later in done[1:]:
        # what was said of a slice before is void, with or without refusals now
        replaced = later.where("request_id is null").select(*_PART)
        refused = refused.join(replaced, _PART, "left_anti").unionByName(later)
    if rest is not None:
        refused = refused.join(rest.select(*_PART).distinct(), _PART, "left_anti").unionByName(_decided(rest, _RUN, window_us))
    return refused.where("request_id is not null").select(
        "request_id", "bucket", "client", F.timestamp_micros("_us").alias("seen_at"))
