"""Document files, registries and label files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake import fixed
from docketlake.functions.files import extension_of, plain_text
from docketlake.functions.text import base_name, quoted

REGISTRY_SCHEMA = (
    "total_documents long, documents_with_expiration long, retention_categories map<string,long>, "
    "expiration_tracking array<struct<tracking_id:string,vendor:string,document_type:string,"
    "filename:string,file_path:string,expiration_date:string,renewal_date:string,"
    "review_date:string,retention_category:string,contract_value:long>>"
)
LABEL_SCHEMA = "doc_id long, text string, doc_type string, vendor string, is_default boolean, source string"


def read_document_files(
    spark: SparkSession, path: str, extensions=fixed.FILE_EXTENSIONS
) -> DataFrame:
    """Documents below ``path``: one folder per vendor, hidden and working folders left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    # the path column carries the file system's prefix, so the root is searched in it
    inner = F.regexp_extract("path", f"^.*?{quoted(root)}(.*)$", 1)
    parts = F.split(inner, "/")
    folder = F.when(F.size(parts) > 1, parts[0])
    return (
        files.withColumns({"folder": folder, "original_name": base_name(F.col("path"))})
        .where(extension_of(F.col("path")).isin(*extensions))
        .where(F.col("folder").isNotNull() & ~F.col("folder").rlike(r"^[._]"))
        .withColumn("doc_id", F.xxhash64("path"))
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files with their leading text; undecodable bytes are left out."""
    files = read_document_files(spark, path, (".txt",))
    return files.select("doc_id", "path", "folder", "original_name", plain_text(F.col("content")).alias("text"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tracked documents of a registry file; a missing or broken file gives no rows."""
    entries = "expiration_tracking"
    try:
        found = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE")
    except Exception as failure:
        if "PATH_NOT_FOUND" not in str(failure):
            raise
        found = spark.createDataFrame([], REGISTRY_SCHEMA)
    return found.select(F.explode(entries).alias("entry")).select("entry.*")


def read_pseudo_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)
