"""Connected components of links, in rounds of hooking and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.shared import written


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, comp``) after joining the components that ``links`` (``a, b``, nodes) connect.

    A component's label is the smallest of the labels it was joined from. Every round hooks each component to its smallest neighbour and
    follows the hooks to their roots, so the number of components with links halves at least. All tables stay in Spark.
    """
    while True:
        ends = (
            links.join(labels.withColumnsRenamed({"node": "a", "comp": "ca"}), "a")
            .join(labels.withColumnsRenamed({"node": "b", "comp": "cb"}), "b")
            .where("ca <> cb").select(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).distinct())
        # A component's smallest neighbour is below it unless it is the smallest itself.
        hooks = written(ends.groupBy(F.col("high").alias("comp")).agg(F.min("low").alias("root")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:
            above = hooks.select(F.col("comp").alias("root"), F.col("root").alias("top"))
            jumped = written(hooks.join(above, "root", "left").select("comp", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("comp", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
