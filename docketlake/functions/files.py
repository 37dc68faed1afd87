"""Checks on raw file content (columns as read by the ``binaryFile`` source)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketlake import fixed
from docketlake.functions.text import base_name, file_extension


def extension_of(path: Column) -> Column:
    return F.lower(file_extension(base_name(path)))


def plain_text(content: Column, limit: int | None = fixed.PLAIN_TEXT_LIMIT) -> Column:
    """UTF-8 text of a file; bytes that are none are left out."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return text if limit is None else F.substring(text, 1, limit)


def upload_error(extension: Column, size: Column, content: Column) -> Column:
    """Why a file is refused, null if it is taken."""
    def wrong(kind):
        return F.lit(f"Uploaded file content does not match {kind} extension")

    head = F.substring(content, 1, 8)
    zip_file = F.startswith(content, F.lit(b"PK\x03\x04")) & F.contains(content, F.lit(b"PK\x05\x06"))
    return (
        F.when(~extension.isin(*fixed.FILE_EXTENSIONS), F.concat(F.lit("Unsupported file type: "), extension))
        .when(size <= 0, F.lit("Uploaded file is empty"))
        .when((extension == ".pdf") & ~F.startswith(content, F.lit(b"%PDF")), wrong(".pdf"))
        .when((extension == ".docx") & ~zip_file, wrong(".docx"))
        .when((extension == ".txt") & F.contains(head, F.lit(b"\x00")), wrong(".txt"))
    )


def scan_result(size: Column, content: Column) -> Column:
    """``struct(scan_status, scan_message)``; looks at the whole content."""
    def result(status, message):
        return F.struct(F.lit(status).alias("scan_status"), F.lit(message).alias("scan_message"))

    infected = F.contains(content, F.lit(fixed.VIRUS_TEST_MARKER.encode()))
    return (
        F.when(size == 0, result("error", "Uploaded file is empty"))
        .when(infected, result("infected", "EICAR test signature detected"))
        .otherwise(result("clean", "Built-in scan passed"))
    )


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)
