"""Free-form answers of a text model, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import let, strip

_JSON_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def _json_answer(text: Column) -> Column:
    """Answer struct of a JSON object, null where it is none or names no known type."""
    def answer(fields: Column) -> Column:
        def value(key: str) -> Column:
            shown = F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit("None"))
            return strip(F.when(F.map_contains_key(fields, key), shown).otherwise(""))

        kind = F.upper(value("doc_type"))
        told = F.struct(kind.alias("doc_type"), value("vendor").alias("vendor"))
        return F.when(fields.isNotNull() & kind.isin("", *fixed.MODEL_TYPES), told)

    parsed = F.from_json(F.when(text.startswith("{"), text), "map<string,string>", _JSON_OPTIONS)
    return let(parsed, answer)


def _loose_answer(text: Column) -> Column:
    kind = F.upper(F.regexp_extract(text, r"(?iU)doc[_\s-]?type\s*[:=]\s*([A-Za-z]+)", 1))
    vendor = strip(F.regexp_extract(text, r"(?iU)vendor\s*[:=]\s*([^\n,;]+)", 1))
    vendor = F.rtrim(F.btrim(F.btrim(vendor, F.lit('"')), F.lit("'")), F.lit("."))
    known = F.when(kind.isin(*fixed.MODEL_TYPES), kind).otherwise("")
    return F.struct(known.alias("doc_type"), vendor.alias("vendor"))


def parsed_reply(raw: Column) -> Column:
    """``struct(doc_type, vendor)`` of a reply.

    Tried in order: the reply as JSON, the first braces in it, ``key: value`` text.
    """
    return let(strip(F.coalesce(raw, F.lit(""))), lambda reply: F.coalesce(
        _json_answer(reply),
        _json_answer(F.regexp_extract(reply, r"\{[^}]*\}", 0)),
        _loose_answer(reply),
    ))


def truncate_prompt(text: Column) -> Column:
    return F.concat(
        F.lit(fixed.MODEL_INSTRUCTION),
        F.substring(F.coalesce(text, F.lit("")), 1, fixed.PROMPT_TEXT_LIMIT),
    )


def training_target(document_type: Column, vendor: Column) -> Column:
    """The JSON answer a model is trained on; backslashes and quotes are escaped."""
    safe = F.replace(F.replace(vendor, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(
        F.lit('{"doc_type": "'), document_type, F.lit('", "vendor": "'), safe, F.lit('"}')
    )
