"""Event-time windows over classified failures."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def failure_rates(stream: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour", kind: str = "kind") -> DataFrame:
    """Failures and total per tumbling window and kind; late rows beyond the watermark are ignored."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, width), kind)
    return windowed.agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failures")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "total", "failures")


def bursts(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of one incident: sightings with pauses shorter than ``gap``."""
    sessions = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key)
    return sessions.agg(F.count(F.lit(1)).alias("sightings")).select(
        key, F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), "sightings")
