"""Registry of the queries of this package and their reference SQL."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


BATCH_BYTES = "8m"


def with_package(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> SparkSession:
    """Settings that the operators rely on, where the session has none of its own.

    Python workers import this package from where the driver has it (a cluster ships it with the job), and batches of
    texts are bounded by bytes, as a few texts may be very long.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``key`` with optional reference SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(with_package(spark), folder)
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
