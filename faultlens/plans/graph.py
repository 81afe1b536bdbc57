"""Parent-link graphs by pointer doubling.

Each round doubles the covered distance with one equi self-join on (group, node); a group of any size is spread over
tasks. The number of rounds is about log2 of the longest chain and the loop ends by itself on cycles.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from faultlens.plans.lineage import cut_lineage


def climb(nodes: DataFrame, group: Sequence[str], node: str, parent: str, combine: Mapping[str, str] | None = None
          ) -> tuple[DataFrame, list[DataFrame]]:
    """Fold ``combine`` ({column: 'min'|'max'}) over each node and all its ancestors.

    Returns the folded nodes with ``in_cycle`` (the chain never ends) and the jump tables (group, node, jump) for the
    distances 1, 2, 4, … . Parents that are not nodes end a chain. Nodes must be unique per group.
    """
    combine = dict(combine or {})
    known = nodes.select(*group, F.col(node).alias("_p"), F.lit(True).alias("_known"))
    start = nodes.withColumnRenamed(parent, "_p").join(known, [*group, "_p"], "left")
    state = cut_lineage(start.select(
        *group, node, F.when(F.col("_known"), F.col("_p")).alias("jump"), *combine.keys()))
    jumps: list[DataFrame] = []
    live = state.filter(F.col("jump").isNotNull()).count()
    while live:
        jumps.append(state.filter(F.col("jump").isNotNull()).select(*group, node, "jump"))
        ahead = state.select(
            *group, F.col(node).alias("jump"), F.col("jump").alias("_next"), *[F.col(c).alias(f"_a_{c}") for c in combine])
        pick = {"min": F.least, "max": F.greatest}
        folded = {c: pick[how](F.col(c), F.col(f"_a_{c}")) for c, how in combine.items()}
        changed = F.lit(False)
        for c, value in folded.items():
            changed = changed | ~value.eqNullSafe(F.col(c))
        step = state.join(ahead, [*group, "jump"], "left").select(
            *group, node, F.col("_next").alias("jump"), *[value.alias(c) for c, value in folded.items()],
            changed.alias("_changed"))
        state = cut_lineage(step)
        # An acyclic chain loses live nodes every round; equal counts leave only nodes that run into a cycle.
        seen = state.agg(F.count_if(F.col("jump").isNotNull()).alias("live"), F.count_if("_changed").alias("changed")).first()
        if seen["live"] == live and seen["changed"] == 0:
            break
        live = seen["live"]
    result = state.select(*group, node, *combine.keys(), F.col("jump").isNotNull().alias("in_cycle"))
    return result, jumps


def ancestors(seeds: DataFrame, jumps: Sequence[DataFrame], group: Sequence[str], node: str) -> DataFrame:
    """All nodes on the chains of ``seeds`` (group, node) with their least ``distance`` from the seed."""
    found = seeds.select(*group, F.col(node).alias("_at"), F.lit(0).cast("bigint").alias("distance"))
    for power in range(len(jumps) - 1, -1, -1):
        table = jumps[power].select(*group, F.col(node).alias("_at"), F.col("jump"))
        further = found.join(table, [*group, "_at"]).select(
            *group, F.col("jump").alias("_at"), (F.col("distance") + (1 << power)).alias("distance"))
        found = found.unionByName(further).groupBy(*group, "_at").agg(F.min("distance").alias("distance"))
    return found.withColumnRenamed("_at", node)
