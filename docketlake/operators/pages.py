"""From page and paragraph rows to document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake import fixed
from docketlake.functions.regions import has_region
from docketlake.functions.text import strip
from docketlake.operators.ordered import first_rows


def _texts_in_order(df: DataFrame, number: str) -> DataFrame:
    """One row per document with its (few) texts by ``number``."""
    rows = F.array_sort(F.collect_list(F.struct(number, F.coalesce("text", F.lit("")).alias("text"))))
    return df.groupBy("doc_id").agg(rows["text"].alias("texts"))


def document_text(pages: DataFrame, max_pages: int = fixed.TEXT_PAGES) -> DataFrame:
    """Text of the leading pages; near-empty pages are left out, near-empty documents flagged."""
    texts = _texts_in_order(pages.where(F.col("page_no") <= max_pages), "page_no")
    kept = F.filter("texts", lambda t: F.length(strip(t)) > fixed.MIN_PAGE_CHARS)
    joined = texts.select("doc_id", F.array_join(kept, "\n").alias("joined"))
    return joined.select(
        "doc_id",
        F.substring("joined", 1, fixed.TEXT_LIMIT).alias("text"),
        (F.length(strip(F.col("joined"))) < fixed.MIN_DOCUMENT_CHARS).alias("needs_ocr"),
    )


def paragraphs_to_text(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (numbered from 1), one per line, up to the text limit.

    Each paragraph adds at least its line break, so no paragraph beyond the
    limit's number can reach into the text.
    """
    leading = paragraphs.where(F.col("paragraph_no") <= fixed.TEXT_LIMIT)
    lines = F.transform("texts", lambda t: F.concat(t, F.lit("\n")))
    return _texts_in_order(leading, "paragraph_no").select(
        "doc_id", F.substring(F.array_join(lines, ""), 1, fixed.TEXT_LIMIT).alias("text")
    )


def tail_pages_text(pages: DataFrame, n: int = fixed.TAIL_PAGES) -> DataFrame:
    """Text of the last ``n`` pages, a line break after each."""
    last = first_rows(pages, ["doc_id"], [F.col("page_no").desc()], n)
    lines = F.transform("texts", lambda t: F.concat(t, F.lit("\n")))
    return _texts_in_order(last, "page_no").select(
        "doc_id", F.array_join(lines, "").alias("tail_text")
    )


def widen_front_pages(
    pages: DataFrame,
    initial: int = fixed.FRONT_PAGES_FIRST,
    maximum: int = fixed.FRONT_PAGES_MAX,
    min_chars: int = fixed.FRONT_TEXT_MIN,
) -> DataFrame:
    """Read front pages until a region shows or the text is long enough.

    Only the first ``maximum`` pages pass the scan's filter.  The fold over page
    counts stops searching once a document has what it needs.
    """
    texts = _texts_in_order(pages.where(F.col("page_no") <= maximum), "page_no")
    size = F.size("texts")

    def text_of(count):
        used = F.filter(F.slice("texts", F.lit(1), count), lambda t: t != "")
        return F.array_join(F.transform(used, lambda t: F.concat(t, F.lit("\n"))), "")

    def state(text, region, count, done):
        return F.struct(
            text.alias("text"), region.alias("region_found"),
            count.cast("int").alias("pages_read"), done.alias("done"),
        )

    def widen(acc, count):
        text = strip(text_of(count))
        region = has_region(text)
        enough = (text != "") & (region | (F.length(text) >= min_chars))
        return F.when(acc["done"], acc).otherwise(state(text, (text != "") & region, count, enough))

    start = state(F.lit(""), F.lit(False), F.lit(0), F.lit(False))
    counts = F.sequence(F.least(F.lit(initial), size), size)
    read = texts.select("doc_id", F.aggregate(counts, start, widen).alias("read"))
    return read.select("doc_id", "read.text", "read.region_found", "read.pages_read")
