"""Connected components of an edge table, by alternating large-star and small-star steps over written tables.

A table of few edges is joined up by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep

#: Edges that one task joins up by itself, at most (two numbers each); more go through the steps.
ONE_TASK = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the task; the root is the smallest node."""
    rows = list(batches)
    if not rows:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes)).tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    labels = nodes[[find(i) for i in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (any integers): label is the component's smallest node.

    Minima are summed per node before the join, and both sides of each join are written tables, so a node with very many
    edges is split by Spark where it must be. Nothing but two numbers a round comes to the driver. Raises where ``most`` rounds
    do not reach a state that stays.
    """
    now = edges.selectExpr(f"greatest({a}, {b}) AS u", f"least({a}, {b}) AS v").filter("u <> v").distinct()
    now, before = keep(now, "cc"), None
    if now.count() <= ONE_TASK:
        return now.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(_joined_up, "node long, label long")
    for _ in range(most):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        # large star: every neighbour above a node goes to the smallest of the node and its neighbours
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = keep(both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct(), "cc")
        # small star: the neighbours below a node, and the node, go to the smallest of them
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
        now = keep(small.filter("u <> v").distinct(), "cc")
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("label")).selectExpr("u AS node", "label")
    return stars.unionByName(stars.selectExpr("label AS node", "label").distinct())
