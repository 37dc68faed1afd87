"""Rule-based document type and the categories that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import leading_literal, let_sql, raw, unicode_regex

def _score(patterns) -> str:
    """Hits of each pattern, three times their number where the name has one too."""
    parts = []
    for pattern in patterns:
        regex = raw(unicode_regex(pattern))
        hits = f"regexp_count(s.everything, {regex}) * if(s.name rlike {regex}, 3, 1)"
        parts.append(f"if(contains(s.everything, {raw(leading_literal(pattern))}), {hits}, 0)")
    return " + ".join(parts)


def document_type(text: Column, filename: Column) -> Column:
    """The best scoring type; ties go to the type listed first."""
    name = F.regexp_replace(F.lower(F.coalesce(filename, F.lit(""))), "[_-]+", " ")
    everything = F.lower(F.concat(name, F.lit(" "), F.coalesce(text, F.lit(""))))
    searched = F.struct(name.alias("name"), everything.alias("everything"))
    kinds = fixed.TYPE_PATTERNS
    scores = let_sql(searched, f"s -> named_struct({', '.join(f'{raw(k)}, {_score(p)}' for k, p in kinds.items())})")
    top = f"greatest({', '.join(f'q.{k}' for k in kinds)})"
    chain = " ".join(f"when q.{k} = {top} then {raw(k)}" for k in kinds)
    return let_sql(scores, f"q -> case when {top} = 0 then {raw(fixed.DEFAULT_TYPE)} {chain} end")


def retention_category(document_type: Column, has_expiration: Column) -> Column:
    kind = F.upper(F.coalesce(document_type, F.lit("")))
    return (
        F.when(kind.isin("MSA", "CONTRACT", "AGREEMENT"),
               F.when(has_expiration, "long_term").otherwise("indefinite"))
        .when(kind.isin("NDA", "LICENSE"), "indefinite")
        .when(kind.isin("PO", "INVOICE"), "short_term")
        .when(kind == "AMD", "tied_to_parent")
        .when(kind == "SOW", "contracts")
        .otherwise("review_required")
    )


def keyword_score(filename: Column, content: Column, kind: str) -> Column:
    """Three points per word found in the name, one per phrase found in the text."""
    words = fixed.SCORE_WORDS[kind]
    points = [F.contains(filename, F.lit(w)).cast("int") * 3 for w in words["filename"]]
    points += [F.contains(content, F.lit(w)).cast("int") for w in words["content"]]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points])


def failure_code(error_class: Column) -> Column:
    """``struct(error_code, retryable, message)`` of an exception class name."""
    def row(code, retryable, message):
        return F.struct(
            F.lit(code).alias("error_code"),
            F.lit(retryable).alias("retryable"),
            F.lit(message).alias("message"),
        )

    result = row(*fixed.DEFAULT_FAILURE)
    for name, values in fixed.FAILURES.items():
        result = F.when(error_class == name, row(*values)).otherwise(result)
    return result
