"""Ranks and running sums inside a key when one key may hold a large share of all rows.

A plain window sends a whole key to one task. Here rows are range-partitioned on (key, order), so a hot key is
cut into many consecutive pieces; each piece is ranked locally and shifted by the totals of the pieces before it.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.plans.lineage import cut_lineage


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *keys, *order).withColumn("_piece", F.spark_partition_id())
    # The piece number must not change between the two passes below, so it is written out first.
    return cut_lineage(ranged)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    rank: str | None = None,
    maxes_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add per-key running columns over the unique ascending ``order``.

    ``rank`` names a 1-based position; each entry of ``sums`` adds the inclusive running sum of its expression, each
    entry of ``maxes_before`` the largest value of its expression on earlier rows (null when there is none).
    """
    sums, maxes = dict(sums or {}), dict(maxes_before or {})
    pieces = _pieces(df, keys, order)
    totals = pieces.groupBy(*keys, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()],
        *[F.max(expr).alias(f"_m_{name}") for name, expr in maxes.items()],
    )
    # One row per (key, piece): at most one per partition for any key.
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums],
        *[F.max(f"_m_{name}").over(before).alias(f"_bm_{name}") for name in maxes],
    )
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    local_sum = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pieces.select(
        "*",
        F.row_number().over(local).alias("_local"),
        *[F.coalesce(F.sum(expr).over(local_sum), F.lit(0)).alias(f"_l_{name}") for name, expr in sums.items()],
        *[F.max(expr).over(local.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_lm_{name}") for name, expr in maxes.items()],
    )
    conditions = [ranked[name].eqNullSafe(offsets[name]) for name in [*keys, "_piece"]]
    condition = conditions[0]
    for item in conditions[1:]:
        condition = condition & item
    joined = ranked.join(offsets, condition)
    columns = [ranked[name] for name in df.columns]
    if rank:
        columns.append((F.col("_before") + F.col("_local")).cast("bigint").alias(rank))
    columns += [(F.col(f"_b_{name}") + F.col(f"_l_{name}")).alias(name) for name in sums]
    columns += [F.greatest(f"_bm_{name}", f"_lm_{name}").alias(name) for name in maxes]
    return joined.select(*columns)
