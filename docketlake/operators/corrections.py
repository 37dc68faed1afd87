"""Reviewer corrections: checked in order, applied and logged.

A correction is one row: ``doc_id, seq, reviewer_id, fields`` where ``fields``
maps field names to texts; only the fields present are changed.  Corrections of
a document follow each other by seq, then reviewer, then their fields as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketlake import fixed
from docketlake.functions.text import strip
from docketlake.session import staged

_DOMAINS = {
    "document_type": (F.upper, fixed.DOCUMENT_TYPES),
    "execution_status": (F.lower, fixed.EXECUTION_STATUSES),
    "retention_category": (F.lower, fixed.RETENTION_CATEGORIES),
}
_DATES = ("effective_date", "expiration_date", "renewal_date", "review_date", "termination_date")
_FIELDS = (*_DOMAINS, "vendor", "review_notes", *_DATES)
_SEQUENCE = ("seq", "reviewer_id", "_order")
# Whether a correction is good depends on the state of these only.
_ORDERED = ("effective_date", "expiration_date")
_DATE_ORDER = "expiration_date cannot be before effective_date"
# Corrections of one document that are folded as one list, at most.
FOLD = 200
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _has(name: str) -> Column:
    return F.map_contains_key("fields", name)


def _given(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.lit(""))


def _date(name: str) -> Column:
    given = _given(name)
    return F.when(given.rlike(_ISO), F.try_to_date(given, "yyyy-M-d"))


def _given_values() -> dict[str, Column]:
    """What a correction makes of every correctable field that it names."""
    def blank_to_null(col):
        return F.when(col != "", col)

    values = {name: blank_to_null(case(_given(name))) for name, (case, _) in _DOMAINS.items()}
    values["vendor"] = blank_to_null(strip(_given("vendor")))
    values["review_notes"] = _given("review_notes")
    return values | {name: _date(name) for name in _DATES}


def _new_values() -> dict[str, Column]:
    """Value of every correctable field after the correction."""
    return {name: F.when(_has(name), value).otherwise(F.col(name)) for name, value in _given_values().items()}


def _first_error() -> Column:
    """Message of the first rule that a correction breaks by itself, null if none."""
    rules = []
    for name, (case, domain) in _DOMAINS.items():
        rules.append((_has(name) & ~case(_given(name)).isin("", *domain), f"Invalid {name}"))
    rules.append((F.length(_given("review_notes")) > fixed.MAX_REVIEW_NOTES, "review_notes is too long"))
    for name in _DATES:
        rules.append((_has(name) & (_given(name) != "") & _date(name).isNull(), f"{name} must be YYYY-MM-DD"))
    return F.coalesce(*[F.when(broken, message) for broken, message in rules])


def _marked() -> Column:
    """``mark_reviewed`` is set by true (in any case) or 1; every other text leaves the status."""
    return F.lower(_given("mark_reviewed")).isin("true", "1")


def checked_corrections(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Corrections next to the state of their document, with the reason of refusal (or null).

    Each correction is checked against the state that the accepted ones before it
    have left; ``applied`` numbers the accepted ones of a document.  What a
    correction says is checked in expressions; only the order of dates needs the
    state.  It is found by a fold over the few columns that matter of a document's
    corrections; the other fields follow from windows.  A document with more than
    FOLD corrections passes through a task in order instead, one row in memory.
    """
    known = docs.select("doc_id", "tenant_id", *_FIELDS, "review_status").withColumn("_known", F.lit(True))
    patches = patches.withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    # what a correction says by itself is found before the join: one join and one sort carry few columns
    told = patches.withColumns({"_fault": _first_error(), "_marked": _marked(), "_order": F.to_json("fields"), **_told(*_ORDERED)})
    joined = told.join(known, "doc_id", "left").withColumns({
        "error": F.when(F.col("_known").isNull(), "Document not found").otherwise(F.col("_fault")),
        "applied": F.lit(None).cast("long"),
    }).drop("_known", "_fault")
    columns = [name for name in joined.columns if not name.startswith("_")]
    crowded = patches.groupBy("doc_id").count().where(F.col("count") > FOLD).select("doc_id")
    if crowded.isEmpty():
        return _folded(joined).select(*columns)
    crowded = staged(crowded, "crowded")
    return _folded(joined.join(crowded, "doc_id", "left_anti")).select(*columns).unionByName(
        _in_order(joined.join(crowded, "doc_id", "left_semi")).select(*columns))


def _told(*names: str) -> dict[str, Column]:
    """Whether a correction names the fields, and what it makes of those it names."""
    given = _given_values()
    return {f"_has_{name}": _has(name) for name in names} | {f"_new_{name}": given[name] for name in names}


def _folded(joined: DataFrame) -> DataFrame:
    """Corrections with error, applied and the state before them; everything stays in the JVM and in one sort."""
    group = W.partitionBy("doc_id").orderBy(*_SEQUENCE)
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dates = dict(zip(("start", "end"), _ORDERED))
    change = F.struct(F.col("error").isNull().alias("sound"), *[
        F.col(f"_{part}_{name}").alias(f"{part}_{k}") for k, name in dates.items() for part in ("has", "new")])

    def step(state: Column, c: Column) -> Column:
        after = {k: F.when(c[f"has_{k}"], c[f"new_{k}"]).otherwise(state[k]) for k in dates}
        good = c["sound"] & ~F.coalesce(after["end"] < after["start"], F.lit(False))
        return F.struct(*[F.when(good, after[k]).otherwise(state[k]).alias(k) for k in dates],
                        F.concat(state["good"], F.array(good)).alias("good"))

    begin = F.struct(*[F.col(name).alias(k) for k, name in dates.items()], F.array().cast("array<boolean>").alias("good"))
    placed = joined.withColumns({"_place": F.row_number().over(group), "_changes": F.collect_list(change).over(whole)})
    # the first correction of a document folds all of them, the others read its verdicts
    verdicts = F.when(F.col("_place") == 1, F.aggregate("_changes", begin, step, lambda state: state["good"]))
    judged = placed.withColumn("_verdicts", verdicts).drop("_changes").withColumn("_verdicts", F.first("_verdicts", True).over(whole))
    judged = judged.withColumn("_good", F.get("_verdicts", F.col("_place") - 1)).drop("_verdicts").withColumns(
        _told(*[name for name in _FIELDS if name not in _ORDERED]))
    before = group.rowsBetween(W.unboundedPreceding, -1)
    state = {}
    for name in _FIELDS:
        last = F.last(F.when(F.col("_good") & F.col(f"_has_{name}"), F.struct(F.col(f"_new_{name}").alias("value"))), True).over(before)
        state[name] = F.when(last.isNotNull(), last["value"]).otherwise(F.col(name))
    reviewed = F.coalesce(F.max(F.col("_good") & F.col("_marked")).over(before), F.lit(False))
    state["review_status"] = F.when(reviewed, "reviewed").otherwise(F.col("review_status"))
    number = F.count_if("_good").over(before) + 1
    return judged.withColumns({
        **state, "applied": F.when(F.col("_good"), number),
        "error": F.when(F.col("error").isNull() & ~F.col("_good"), _DATE_ORDER).otherwise(F.col("error")),
    }).select(*joined.columns)


def _in_order(joined: DataFrame) -> DataFrame:
    """The same for documents of any number of corrections: in order, one row in memory."""
    state_names = (*_FIELDS, "review_status")
    joined = joined.withColumns(_told(*_FIELDS))

    def in_order(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, state, applied = object(), {}, 0
        for batch in source:
            out = {name: batch.column(name).to_pylist() for name in (*state_names, "error", "applied")}
            read = {name: batch.column(name).to_pylist() for name in batch.schema.names
                    if name in ("doc_id", "_marked") or name.startswith(("_new_", "_has_"))}
            for i, doc_id in enumerate(read["doc_id"]):
                if doc_id != document:
                    document, state, applied = doc_id, {n: out[n][i] for n in state_names}, 0
                for name in state_names:
                    out[name][i] = state[name]
                if out["error"][i] is not None:
                    continue
                after = {n: read[f"_new_{n}"][i] if read[f"_has_{n}"][i] else state[n] for n in _FIELDS}
                start, end = after["effective_date"], after["expiration_date"]
                if start is not None and end is not None and end < start:
                    out["error"][i] = _DATE_ORDER
                    continue
                after["review_status"] = "reviewed" if read["_marked"][i] else state["review_status"]
                applied += 1
                state, out["applied"][i] = after, applied
            yield pa.record_batch(
                [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name) for f in batch.schema],
                names=batch.schema.names)

    ordered = joined.repartition("doc_id").sortWithinPartitions("doc_id", *_SEQUENCE)
    return ordered.mapInArrow(in_order, joined.schema)


def rejected_corrections(checked: DataFrame) -> DataFrame:
    return checked.where("error is not null").select("doc_id", "seq", "error")


def correction_changes(checked: DataFrame) -> DataFrame:
    """Old and new text of every changed field of the accepted corrections."""
    new = _new_values()
    entries = [
        F.when(_has(name), F.struct(
            F.lit(name).alias("field"),
            F.col(name).cast("string").alias("old_value"),
            value.cast("string").alias("new_value"),
        ))
        for name, value in new.items()
    ]
    entries.append(F.when(_marked(), F.struct(
        F.lit("review_status").alias("field"),
        F.col("review_status").alias("old_value"), F.lit("reviewed").alias("new_value"),
    )))
    # the entries are a column of their own: made in compiled code, not inside the filter's interpreted one
    told = checked.where("error is null").select("doc_id", "tenant_id", "reviewer_id", F.array(*entries).alias("entries"))
    kept = F.filter("entries", lambda e: e.isNotNull())
    return told.select("doc_id", "tenant_id", "reviewer_id", F.inline(kept))


def change_log(checked: DataFrame, as_of) -> DataFrame:
    """One row per accepted correction with its changes as JSON, ready for the audit."""
    new = _new_values()
    shown = []
    for name in _DOMAINS:
        pair = F.struct(F.col(name).alias("old"), new[name].alias("new"))
        shown.append(F.when(_has(name), pair).alias(name))
    shown.append(F.when(_has("vendor"), new["vendor"]).alias("vendor"))
    shown.append(F.when(_has("review_notes"), F.lit(True)).alias("review_notes"))
    shown += [F.when(_has(n), _given(n)).alias(n) for n in _DATES]
    shown.append(F.when(_marked(), F.lit("reviewed")).alias("review_status"))
    return checked.where("error is null").select(
        "doc_id", "tenant_id", F.col("reviewer_id").alias("user_id"),
        F.to_json(F.struct(*shown)).alias("changes"), F.lit(as_of).cast("timestamp").alias("changed_at"),
    )


def apply_corrections(docs: DataFrame, checked: DataFrame, as_of) -> DataFrame:
    """All documents, accepted corrections applied."""
    new = _new_values()
    updates = checked.where("error is null").groupBy("doc_id").agg(
        F.lit(True).alias("_patched"),
        F.max_by(F.struct(*[v.alias(n) for n, v in new.items()]), "applied").alias("_new"),
        F.max_by(F.struct("reviewer_id"), F.when(_marked(), F.col("applied"))).alias("_mark"),
    )
    joined = docs.join(updates, "doc_id", "left")
    marked = F.col("_mark").isNotNull()
    columns = {
        name: F.when(F.col("_patched"), F.col(f"_new.{name}")).otherwise(F.col(name)) for name in new
    }
    columns["review_status"] = F.when(marked, "reviewed").otherwise(F.col("review_status"))
    columns["reviewed_by_id"] = F.when(marked, F.col("_mark.reviewer_id")).otherwise(F.col("reviewed_by_id"))
    columns["reviewed_at"] = F.when(marked, F.lit(as_of).cast("timestamp")).otherwise(F.col("reviewed_at"))
    return joined.withColumns(columns).select(*docs.columns)
