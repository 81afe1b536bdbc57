"""Latest-wins merge on plain tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``. ``max_by`` combines map-side, so a hot key costs one row per task."""
    row = F.struct(*[F.col(name) for name in df.columns])
    rank = F.struct(*[F.col(name) for name in order])
    picked = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row"))
    return picked.select("_row.*")


def merge_latest(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of stored rows and updates reduced to the latest row per key."""
    return latest_per_key(target.unionByName(updates, allowMissingColumns=True), keys, order)
