"""Connected components of a small-to-large edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.working import keep


def connected_components(edges: DataFrame, most: int = 50) -> DataFrame:
    """``node, label``; label is the smallest node of its component. Labels spread along edges and jump to their own labels.

    Raises where ``most`` rounds do not reach labels that stay; a round takes labels about twice as far, so a chain of n
    nodes needs about log n of them. Every round is a written table. Each edge table is
    joined on its node and summed by a minimum, so a node with very many edges is a skewed join that AQE splits.
    """
    both = keep(edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")).distinct(), "graph-edges")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "graph-labels")
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        spread = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = keep(spread.join(jump, "label").select("node", "before", F.least("label", "next").alias("label")), "graph-labels")
        labels = now.select("node", "label")
        if now.filter("label <> before").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")
