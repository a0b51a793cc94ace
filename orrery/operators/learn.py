"""Perceptrons over sparse features: updates as rows, averages as aggregates, shards mixed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def averaged_weights(updates: DataFrame, steps: int) -> DataFrame:
    """feature, final and average weight of (feature, step, delta) updates, steps counted from 1.

    An update at step t is in the weights of the steps t to ``steps``, so the mean over all
    steps is sum(delta * (1 - (t - 1) / steps)): one aggregate, no pass in order.
    """
    late = F.col("delta") * (1 - (F.col("step") - 1) / F.lit(float(steps)))
    return updates.groupBy("feature").agg(F.sum("delta").alias("final"), F.sum(late).alias("average"))


def updates_of(rows: pd.DataFrame, passes: int, mode: str) -> Iterator[tuple[str, int, float]]:
    """Updates of a binary perceptron over rows (y in -1, 1; feats) in order: ``plain`` after each error, ``margin`` up to a margin of 1."""
    w: dict[str, float] = {}
    step = 0
    for _ in range(passes):
        for y, feats in zip(rows["y"], rows["feats"], strict=True):
            step += 1
            score = y * sum(w.get(f, 0.0) for f in feats)
            if score <= 0 if mode == "plain" else score < 1:
                for f in feats:
                    w[f] = w.get(f, 0.0) + y
                    yield f, step, float(y)


def perceptron(rows: DataFrame, shard: str, order: str, passes: int = 1, mode: str = "plain") -> DataFrame:
    """feature and weight: averaged perceptrons of every shard, mixed by their mean.

    Rows are (shard, order, y, feats); a shard is trained in one task, so it has to fit there.
    """
    if mode not in ("plain", "margin"):
        raise ValueError(mode)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame([(*u, passes * len(pdf)) for u in updates_of(pdf, passes, mode)], columns=["feature", "step", "delta", "steps"])

    updates = rows.select(shard, order, "y", "feats").groupBy(shard).applyInPandas(train, "feature string, step long, delta double, steps long")
    shards = rows.agg(F.countDistinct(shard).alias("shards"))
    late = F.col("delta") * (1 - (F.col("step") - 1) / F.col("steps"))
    return updates.groupBy("feature").agg(F.sum(late).alias("w")).crossJoin(F.broadcast(shards)).select("feature", (F.col("w") / F.col("shards")).alias("weight"))  # one row


def linear_scores(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Score of every row (key, feats): the sum of its features' weights, 0 for unknown ones."""
    own = rows.select(key, F.explode("feats").alias("feature")).join(weights, "feature")
    return rows.select(key).join(own.groupBy(key).agg(F.sum("weight").alias("score")), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
