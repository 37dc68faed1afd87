"""Small string expressions shared by the text functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

MARKED_SPACE = r"(?U)^\s+|\s+$"


def strip(col: Column) -> Column:
    """Remove every kind of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col, MARKED_SPACE, "")


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[null_if_empty(c) for c in cols], F.lit(""))


def unicode_regex(pattern: str, flags: str = "") -> str:
    """Make ``\\w \\s \\d \\b`` cover all of Unicode, plus further flags."""
    return f"(?{flags}U){pattern}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    Also when a filter on the result is pushed down and the whole expression is
    repeated there, ``value`` stays one computation per copy.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def let_sql(value: Column, body: str) -> Column:
    """Like ``let`` with the use written as a SQL lambda (``x -> ...``).

    For expressions of very many parts: one text parses much faster than its parts
    are built one by one.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(body)), 1)


def raw(text: str) -> str:
    """SQL literal in which backslashes mean themselves."""
    assert "'" not in text
    return f"r'{text}'"


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def leading_literal(pattern: str) -> str:
    """Plain text that every match of ``pattern`` starts with (maybe none).

    Looking for it costs a small part of a regular expression, so texts without it
    need not be searched.  For patterns without alternatives at their top level.
    """
    rest = pattern.removeprefix(r"(?<!\w)")
    found = []
    while rest:
        char, rest = rest[0], rest[1:]
        if char == "\\":
            if rest[:1].isalnum():
                break
            char, rest = rest[0], rest[1:]
        elif char in ".[(|^$)*+?{":
            break
        if rest[:1] in ("?", "*", "{"):
            break
        found.append(char)
    return "".join(found)


def inner_literal(pattern: str) -> str:
    """The longest plain text outside of groups that every match of ``pattern`` holds (maybe none).

    Without ``s``, ``i`` and ``k``, which Unicode has further forms of.  For patterns
    without alternatives at their top level.
    """
    tokens = re.findall(r"\\.|\[[^\]]*\]|\{[^}]*\}|.", pattern, re.DOTALL)
    runs, depth = [""], 0
    for token, after in zip(tokens, [*tokens[1:], ""]):
        depth += (token == "(") - (token == ")")
        plain = token if len(token) == 1 and token not in ".^$|*+?()" else token[1:] if token[0] == "\\" and not token[1].isalnum() else ""
        if plain and not depth and plain not in "sik" and after not in ("?", "*") and not after.startswith("{"):
            runs[-1] += plain
        else:
            runs.append("")
    return max(runs, key=len)


def quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def file_extension(name: Column) -> Column:
    """Extension with its dot; names of dots only have none."""
    return F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_extension(name)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def iso_timestamp(ts: Column) -> Column:
    """ISO text; the fraction appears only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(
        F.unix_micros(ts) % 1000000 == 0, whole
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
