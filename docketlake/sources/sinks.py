"""Writers.  All of them write from the tasks; none gathers rows on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketlake.functions.naming import clean_filename, tracking_id
from docketlake.operators.registry import expiration_tracking, registry_rollup, registry_totals


def write_registry(df: DataFrame, path: str) -> None:
    """Totals, retention counts and expiration list as JSON-lines folders."""
    registry_totals(df).write.mode("overwrite").json(f"{path}/totals")
    registry_rollup(df).write.mode("overwrite").json(f"{path}/retention_categories")
    expiration_tracking(df).write.mode("overwrite").json(f"{path}/expiration_tracking")


METADATA_BUCKETS = 64


def metadata_rows(analysed: DataFrame) -> DataFrame:
    """One metadata JSON text per analysed document, with the bucket of its vendor."""
    fields = [
        "original_name", "vendor", "clean_vendor", "document_type", "execution_status", "date_str",
        "signature_analysis", "date_metadata", "retention_category",
    ]
    extra = [c for c in ("new_filename", "resolved_path") if c in analysed.columns]
    track = tracking_id(F.col("vendor"), F.col("document_type"), F.col("path")).alias("tracking_id")
    bucket = F.pmod(F.xxhash64("clean_vendor"), F.lit(METADATA_BUCKETS)).alias("vendor_bucket")
    return analysed.where("error is null").select(
        bucket, F.to_json(F.struct(*fields, *extra, track)).alias("value")
    )


def write_metadata(analysed: DataFrame, path: str) -> None:
    """Folders by vendor bucket: a reader of one vendor opens one of them, and their
    number does not grow with the vendors.  Rebalancing gathers a bucket's rows into
    few files and splits the bucket of a very large vendor."""
    rows = metadata_rows(analysed).hint("rebalance", F.col("vendor_bucket"))
    rows.write.mode("overwrite").partitionBy("vendor_bucket").text(path)


def write_pseudo_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Reports and exports: with a header, in the order of the frame."""
    df.write.mode("overwrite").csv(path, header=True)


def write_text_files(rows: DataFrame, path: str, folder: str, name: str, order: list[str], value: str = "value") -> None:
    """One text file for every pair of ``folder`` and ``name``, with a line for every row, in order.

    On a local or mounted folder the tasks write ``folder=a/name=b.txt`` themselves.
    Spark's writer would make a folder for each file, and Hadoop's local file system
    several child processes (permissions, checksum) for each.  On other file systems
    it is Spark's writer, with ``folder=a/name=b/`` around the file.
    """
    laid = rows.withColumn(folder, F.nullif(F.col(folder).cast("string"), F.lit(""))).repartition(folder, name).sortWithinPartitions(
        folder, name, *order).select(folder, name, value)
    root = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        laid.write.partitionBy(folder, name).text(path)
        return
    target = root.toUri().getPath()
    os.makedirs(target)

    def named(key: str, part) -> str:
        """As Spark names the folders of ``partitionBy``."""
        if part is None:
            return f"{key}=__HIVE_DEFAULT_PARTITION__"
        return f"{key}=" + re.sub(r"""["#%'*/:=?\\\x01-\x1f\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", str(part))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file gets its name when it is whole; readers leave out names that begin with a dot
        attempt, done, key, out = TaskContext.get().taskAttemptId(), 0, None, None

        def finish() -> None:
            out.close()
            os.replace(out.name, f"{target}/{named(folder, key[0])}/{named(name, key[1])}.txt")

        for batch in batches:
            for *pair, text in zip(*batch.columns):
                pair = tuple(part.as_py() for part in pair)
                if out is None or pair != key:
                    if out is not None:
                        finish()
                    key, done = pair, done + 1
                    os.makedirs(f"{target}/{named(folder, key[0])}", exist_ok=True)
                    out = open(f"{target}/{named(folder, key[0])}/.{named(name, key[1])}.{attempt}", "wb")
                out.write((text.as_buffer() or b"") if text.is_valid else b"")
                out.write(b"\n")
        if out is not None:
            finish()
        yield pa.record_batch([pa.array([done], pa.int64())], names=["files"])

    laid.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def result_location(doc_id: Column, filename: Column) -> Column:
    """Where the result of a document lives; the same for every run."""
    safe = F.regexp_replace(clean_filename(filename), r"\s+", "_")
    name = F.when(safe == "", "result").otherwise(safe)
    return F.concat_ws("/", F.lit("results"), doc_id.cast("string"), name)


class Manifest:
    """What has been published below a folder, in the order in which it was completed.

    One small file per publication, named by its version; a file is never changed.
    A version belongs to whoever creates its file first, so versions of several
    streams follow each other and none is given twice.
    """

    SCHEMA = "version long, stream string, batch_id long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/_manifest"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        """version, stream, batch_id of every publication."""
        return self.spark.read.schema(self.SCHEMA).json(self.folder).where("version is not null")

    def _last(self) -> int:
        root = self._path(self.folder)
        names = [f.getPath().getName() for f in self._files.listStatus(root)] if self._files.exists(root) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def append(self, stream: str, batch_id: int) -> None:
        """Enter a publication as the newest version, unless it has been entered before."""
        version = self._last() + 1
        known = F.col("stream").eqNullSafe(stream) & (F.col("batch_id") == batch_id)
        if version > 1 and not self.entries().where(known).isEmpty():
            return
        while True:
            try:
                out = self._files.create(self._path(f"{self.folder}/{version:020d}.json"), False)
                break
            except Py4JJavaError as taken:
                if "FileAlreadyExists" not in str(taken.java_exception):
                    raise
                version += 1
        out.write(json.dumps({"version": version, "stream": stream, "batch_id": batch_id}).encode())
        out.close()


def publish_results(results: DataFrame, path: str, batch_id: int, stream: str = "batch") -> None:
    """Publish one batch of a stream as the newest version.

    A stream's batch owns its folder and enters the manifest when it is written, so
    repeating it after a failure replaces what it wrote before, keeps its place
    among the versions, and touches nothing else.  Rows with an ``error`` are
    published as failed ones.  Streams that publish into one place need names of their own.
    """
    failed = F.col("error").isNotNull().cast("int") if "error" in results.columns else F.lit(0)
    located = results.withColumn("location", result_location(F.col("doc_id"), F.col("new_filename")))
    located.withColumn("failed", failed).write.mode("overwrite").partitionBy("failed").parquet(
        f"{path}/stream={stream}/batch_id={batch_id}")
    Manifest(results.sparkSession, path).append(stream, batch_id)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """Published rows with the version of their batch; what is not in the manifest is not published."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.join(Manifest(spark, path).entries(), ["stream", "batch_id"])


def _latest(rows: DataFrame) -> DataFrame:
    """The version is chosen on the keys alone; only the chosen rows carry their text."""
    last = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id"])


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Latest published row per document; a document that failed later keeps its earlier result."""
    return _latest(_versions(spark, path).where("failed = 0")).drop("failed")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose latest version has failed, with the reason."""
    return _latest(_versions(spark, path)).where("failed = 1").drop("failed")
