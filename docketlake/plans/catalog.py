"""All registered queries: a Spark job each, and where one exists a checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.plans.views import Data, check_sql
from docketlake.session import shared_dir, tune

AS_OF = date(1999, 1, 1)
AS_OF_TIME = datetime(1999, 1, 1)

QUERIES: dict[str, Callable[[Data], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL its result is checked against."""
    def register(job: Callable[[Data], DataFrame]):
        QUERIES[name] = job
        if sql is not None:
            CHECKS[name] = sql
        return job

    return register


def iso(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%dT%H:%M:%S') as {n}" for n in names)


def iso_days(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d') as {n}" for n in names)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written data, next to the checkpoints."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def number(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def load_all() -> None:
    from docketlake.plans import (  # noqa: F401
        queries_documents, queries_jobs, queries_naming, queries_streams, queries_text,
    )


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(job):
        return lambda spark, folder: job(Data(tune(spark), folder))

    return {name: bind(job) for name, job in QUERIES.items()}


def checking_sql() -> dict[str, str]:
    load_all()
    return {name: check_sql(sql) for name, sql in CHECKS.items()}
