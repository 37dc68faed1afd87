"""Schemas of the stored tables, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

SCHEMAS = {
    "tenants": "tenant_id long, name string, slug string, created_at timestamp",
    "users": "user_id long, tenant_id long, email string, name string, role string, "
             "is_active boolean, created_at timestamp, updated_at timestamp",
    "documents": "doc_id long, tenant_id long, uploaded_by_id long, reviewed_by_id long, "
                 "original_name string, stored_path string, storage_backend string, "
                 "storage_key string, source_storage_key string, result_storage_key string, "
                 "file_size long, checksum string, status string, error_message string, "
                 "scan_status string, scan_message string, scanned_at timestamp, "
                 "review_status string, review_notes string, reviewed_at timestamp, "
                 "document_type string, vendor string, effective_date date, expiration_date date, "
                 "renewal_date date, review_date date, termination_date date, "
                 "retention_category string, execution_status string, generated_filename string, "
                 "processed_folder string, metadata_json string, text string, "
                 "created_at timestamp, updated_at timestamp",
    "document_relationships": "relationship_id long, tenant_id long, source_document_id long, "
                              "target_document_id long, relationship_type string, "
                              "created_by_id long, created_at timestamp",
    "audit_events": "audit_id long, tenant_id long, user_id long, document_id long, action string, "
                    "details string, ip_address string, user_agent string, created_at timestamp",
    "document_jobs": "job_id long, document_id long, tenant_id long, status string, backend string, "
                     "attempts int, max_attempts int, last_error string, failure_kind string, "
                     "correlation_id string, queue_id string, parent_job_id long, queued_at timestamp, "
                     "retry_at timestamp, heartbeat_at timestamp, lease_token string, "
                     "started_at timestamp, finished_at timestamp, created_at timestamp, "
                     "updated_at timestamp",
    "document_job_attempts": "attempt_id long, job_id long, attempt_number int, worker_name string, "
                             "status string, lease_token string, started_at timestamp, "
                             "heartbeat_at timestamp, finished_at timestamp, duration_ms long, "
                             "retryable boolean, error_code string, error_message string, "
                             "termination_reason string",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven tables from Parquet folders; columns are pruned at the scan."""
    return {
        name: spark.read.schema(schema_of(name)).parquet(f"{path.rstrip('/')}/{name}")
        for name in SCHEMAS
    }


SPREAD_ROWS = 20_000  # rows of a task of text work
MOST_TASKS = 10_000


def spread(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Deal narrow rows evenly to tasks before text work, as many as the rows of ``table`` ask for.

    Text work costs far more than reading.  Files of few row groups leave most
    partitions of a scan empty, however many there are, and a join can end in a few
    large ones; so rows are counted (from the files' footers where ``table``, by
    default ``rows`` itself, is a plain scan), not partitions.
    """
    tasks = (rows if table is None else table).count() // SPREAD_ROWS + 1
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(tasks, MOST_TASKS)))


def load_jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """One table from a database; give partitionColumn and bounds to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
