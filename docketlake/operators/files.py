"""Inventory and checks of raw files (rows of the ``binaryFile`` source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake.functions.files import checksum, extension_of, scan_result, upload_error
from docketlake.functions.naming import format_file_size


def file_info(files: DataFrame) -> DataFrame:
    """Size, readable size, extension and modification time."""
    return files.select(
        "path",
        F.col("length").alias("size"),
        format_file_size(F.col("length")).alias("size_formatted"),
        extension_of(F.col("path")).alias("extension"),
        F.col("modificationTime").alias("modified"),
    )


def count_files_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(extension_of(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def validate_upload(files: DataFrame) -> DataFrame:
    """Add ``upload_error`` (null for files that are taken)."""
    error = upload_error(extension_of(F.col("path")), F.col("length"), F.col("content"))
    return files.withColumn("upload_error", error)


def scan_content(files: DataFrame) -> DataFrame:
    return files.withColumn("_scan", scan_result(F.col("length"), F.col("content"))).select(
        *files.columns, F.col("_scan.scan_status").alias("scan_status"),
        F.col("_scan.scan_message").alias("scan_message"),
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Everything known of a file in one pass; the content itself is not carried on."""
    scanned = scan_content(validate_upload(files))
    return scanned.select(
        "path",
        extension_of(F.col("path")).alias("extension"),
        F.col("length").alias("size"),
        format_file_size(F.col("length")).alias("size_formatted"),
        checksum(F.col("content")).alias("checksum"),
        "upload_error", "scan_status", "scan_message",
    )
