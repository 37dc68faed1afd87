"""Generated file names, folders and display forms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import file_extension


def _lookup(values: dict, key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def enhanced_filename(vendor: Column, document_type: Column, original: Column, number: Column) -> Column:
    return F.format_string(
        "%s_%s_%s_%03d%s",
        _lookup(fixed.TYPE_ABBREVIATIONS, document_type, "K"),
        vendor,
        _lookup(fixed.TYPE_DESCRIPTIONS, document_type, "document"),
        number.cast("long"),
        file_extension(original),
    )


def simple_filename(vendor: Column, original: Column, date_str: Column) -> Column:
    return F.concat_ws("_", F.when(date_str != "", date_str), vendor, original)


def route_folder(folder: Column, status: Column) -> Column:
    return F.concat(folder, F.lit("_"), status)


def clean_filename(name: Column) -> Column:
    bad = '<>:"/\\|?*'
    return F.btrim(F.regexp_replace(F.translate(name, bad, "_" * len(bad)), "_+", "_"), F.lit("_ "))


def format_file_size(size: Column) -> Column:
    """One decimal, ties to even, in steps of 1024 up to TB."""
    units = ("B", "KB", "MB", "GB", "TB")

    def shown(power: int) -> Column:
        value = F.bround(size.cast("double") / float(1024 ** power), 1)
        return F.format_string("%.1f" + units[power], value)

    text = shown(4)
    for power in (3, 2, 1, 0):
        text = F.when(size < 1024 ** (power + 1), shown(power)).otherwise(text)
    return F.when(size == 0, "0B").otherwise(text)


def tracking_id(vendor: Column, document_type: Column, path: Column) -> Column:
    """Readable id with four digits of a hash that is the same in every run."""
    digest = F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long")
    return F.format_string("%s_%s_%04d", vendor, document_type, F.pmod(digest, F.lit(10000)))
