"""Session construction with the settings the operators rely on."""
from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "faultlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and dynamic partition overwrite.

    ``master`` stays unset on a cluster so that spark-submit decides; tests pass ``local[N]``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
