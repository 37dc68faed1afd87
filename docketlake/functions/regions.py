"""Does a text contain the parties' preamble or a title line?"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import unicode_regex


# Short, linear searches that any match of the pattern must contain.
_NEEDED = (
    r"hereinafter\s+(?:called|referred)",
    r"between[^.]{0,300}?and\s+[A-Z]",
    r",\s+a\s+\w+\s+(?:corporation|company|llc|partnership|limited)",
    None,
)


def has_region(text: Column) -> Column:
    """Title words are searched first; a long-running pattern only where its fixed
    part occurs, and none after the first hit."""
    body = F.coalesce(text, F.lit(""))
    hit = F.lit(False)
    for pattern, needed in zip(fixed.REGION_PATTERNS, _NEEDED):
        found = body.rlike(unicode_regex(pattern, "i"))
        if needed is not None:
            found = body.rlike(unicode_regex(needed, "i")) & found
        hit = found | hit
    return hit
