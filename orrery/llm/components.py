"""Connected components by hooking and pointer jumping, all in DataFrames.

Every node hooks to its least smaller neighbour, paths are halved until they end at
roots, and the edges between different roots form the next, smaller graph. Nothing
is collected; each round is written to the shared checkpoint folder. A hub with many
neighbours is only ever aggregated with a partial minimum or met in a join that
adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge to another one."""
    live = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    labels = None
    while not live.isEmpty():
        parent = cut(live.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("g"))
            step = cut(parent.join(up, "p", "left").select("u", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")))
            parent = step.select("u", "p")
            if step.where("moved").isEmpty():
                break
        root = parent.select(F.col("u").alias("n"), F.col("p").alias("r"))
        x = live.join(root.withColumnRenamed("n", "u").withColumnRenamed("r", "ru"), "u", "left").join(root.withColumnRenamed("n", "v").withColumnRenamed("r", "rv"), "v", "left")
        x = x.select(F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv"))
        live = cut(x.where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        own = root.select(F.col("n").alias("node"), F.col("r").alias("component"))
        if labels is None:
            labels = own
        else:  # older labels follow their roots, and roots hooked just now get labels of their own
            moved = labels.join(own.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = moved.unionByName(own)
        labels = cut(labels)
    if labels is None:
        return edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("component")).limit(0)
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)


def smallest_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of each row's and column's component in the bipartite graph ``linked``."""
    most = np.iinfo(np.int64).max
    while True:
        r = np.minimum(left, np.where(linked, right[None], most).min(1, initial=most))
        c = np.minimum(right, np.where(linked, r[:, None], most).min(0, initial=most))
        if (r == left).all() and (c == right).all():
            return r, c
        left, right = r, c
