"""Connected components of an edge table by minimum labels and pointer jumping.

Works on pre-aggregated stars: every round sends at most one label for each
edge, so hubs cost a partial aggregate and not a collected neighbour list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long), any direction -> (node, label), the smallest node reachable.

    Nodes without an edge are absent.  Null ends and loops are ignored; an
    empty table gives an empty table.
    """
    pairs = edges.where("u is not null and v is not null and u <> v")
    both = scratch.cut(pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.cut(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")))
    for _ in range(max_rounds):
        far = both.join(labels.withColumnsRenamed({"node": "v", "label": "far"}), "v").select(F.col("u").alias("node"), F.col("far").alias("label"))
        near = far.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.cut(near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
