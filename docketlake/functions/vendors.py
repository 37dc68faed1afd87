"""Vendor names from folders and file names, and their comparable forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import (
    leading_literal, let, let_sql, null_if_empty, raw, strip, unicode_regex,
)

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _without_suffixes(name: Column) -> Column:
    """One pass per suffix: taking one away can complete a dotted one before it."""
    steps = "v"
    for suffix in fixed.VENDOR_SUFFIX_PATTERNS:
        shorter = f"regexp_replace(n, {raw(unicode_regex(suffix))}, '')"
        step = f"n -> if(contains(n, {raw(leading_literal(suffix))}), {shorter}, n)"
        steps = f"element_at(transform(array({steps}), {step}), 1)"
    return let_sql(name, f"v -> {steps}")


def normalize_vendor(name: Column) -> Column:
    """Lower case without company suffixes and punctuation."""
    out = _without_suffixes(F.lower(F.coalesce(name, F.lit(""))))
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_vendor(name: Column) -> Column:
    """Form used in file names: no blanks or punctuation, first letter upper case."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\w\s-]|[\s-]+", "")
    return let(kept, lambda k: F.when(k == "", "UnknownVendor").otherwise(
        F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, F.lit(2), F.length(k)))
    ))


def vendor_from_folder(folder: Column) -> Column:
    def vendor_words(name: Column) -> Column:
        words = F.filter(
            F.split(name, r"(?U)[\s_-]+"),
            lambda w: ~w.isin(*fixed.FOLDER_SUFFIX_WORDS) & (w != ""),
        )
        telling = (name != "") & ~name.rlike(_UUID) & ~name.isin(*fixed.GENERIC_FOLDERS)
        return F.when(telling, F.coalesce(null_if_empty(F.array_join(words, " ")), folder))

    # a folder of blanks only has no words and stays as it is
    blank = F.when((folder != "") & (strip(folder) == ""), folder)
    return F.coalesce(blank, let(strip(F.lower(folder)), vendor_words))


def vendor_from_filename(filename: Column) -> Column:
    """Words before the first type word or two to four digit number."""
    base = F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", "")
    tokens = F.filter(F.split(base, r"(?U)[\s_\-]+"), lambda t: t != "")

    def before_stop(words: Column) -> Column:
        stops = F.transform(
            words,
            lambda t: F.lower(t).isin(*fixed.FILENAME_STOP_WORDS) | t.rlike(r"(?U)^\d{2,4}$"),
        )
        # a stop word is appended, so there always is a first one
        first = F.array_position(F.array_append(stops, F.lit(True)), F.lit(True)).cast("int")
        return F.array_join(F.slice(words, F.lit(1), first - 1), " ")

    return null_if_empty(let(tokens, before_stop))


def vendor_cascade(model_vendor: Column, folder: Column, filename: Column, default: str = "") -> Column:
    """Model answer, else folder, else file name, else ``default``."""
    return F.coalesce(
        null_if_empty(strip(model_vendor)), vendor_from_folder(folder), vendor_from_filename(filename),
        F.lit(default),
    )
