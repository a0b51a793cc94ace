"""Association and information: PMI, information gain, mutual information, selectivity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import merit


def joint_counts(df: DataFrame, y: str, x: str) -> DataFrame:
    """y, x, n_yx, n_y, n_x, n of rows with both; one shuffle for pairs, small ones for the margins."""
    pairs = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(F.col(y).alias("y"), F.col(x).alias("x")).agg(F.count("*").alias("n_yx"))
    ys = pairs.groupBy("y").agg(F.sum("n_yx").alias("n_y"))
    xs = pairs.groupBy("x").agg(F.sum("n_yx").alias("n_x"))
    n = pairs.agg(F.sum("n_yx").alias("n"))
    return pairs.join(ys, "y").join(xs, "x").crossJoin(F.broadcast(n))  # one row


def pmi(n_yx: Column, n_y: Column, n_x: Column, n: Column) -> Column:
    return F.log(n_yx * n / (n_y * n_x))


def discounted(value: Column, n: Column, lam: float) -> Column:
    """PMI pulled to 0 where counts are small."""
    return value * n / (n + lam)


def pmi_table(df: DataFrame, y: str, x: str, lam: float = 0.0) -> DataFrame:
    c = joint_counts(df, y, x)
    value = pmi(F.col("n_yx").cast("double"), F.col("n_y"), F.col("n_x"), F.col("n"))
    return c.withColumn("pmi", value).withColumn("dpmi", discounted(F.col("pmi"), F.col("n_yx"), lam))


def pmi_with_negatives(df: DataFrame, y: str, x: str, positive: str) -> DataFrame:
    """PMI where n counts all instances and n_x positives and negatives, but pairs are positive ones."""
    base = df.groupBy(F.col(y).alias("y"), F.col(x).alias("x")).agg(F.sum(F.col(positive).cast("int")).alias("n_yx"), F.count("*").alias("all_yx"))
    ys = base.groupBy("y").agg(F.sum("n_yx").alias("n_y"))
    xs = base.groupBy("x").agg(F.sum("all_yx").alias("n_x"))
    n = base.agg(F.sum("all_yx").alias("n"))
    out = base.where("n_yx > 0").join(ys, "y").join(xs, "x").crossJoin(F.broadcast(n))
    return out.withColumn("pmi", pmi(F.col("n_yx").cast("double"), F.col("n_y"), F.col("n_x"), F.col("n")))


def top_pmi(table: DataFrame, k: int, by: str = "pmi") -> DataFrame:
    """Each label's ``k`` features of largest score."""
    w = Window.partitionBy("y").orderBy(F.desc(by), "x")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def information_gain(df: DataFrame, y: str, x: str) -> DataFrame:
    c = joint_counts(df, y, x)
    p = F.col("n_yx") / F.col("n")
    return c.agg(F.sum(p * pmi(F.col("n_yx").cast("double"), F.col("n_y"), F.col("n_x"), F.col("n"))).alias("ig"))


def entropy(counts: DataFrame, n: str) -> DataFrame:
    """hx of one column of counts: log z - sum(n log n) / z."""
    v = F.col(n).cast("double")
    return counts.agg((F.log(F.sum(v)) - F.sum(v * F.log(v)) / F.sum(v)).alias("h"))


def template_information(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """hx, hyx, hy and mi by template of (inst, template, x) and (inst, y).

    y counts instances while pairs count features, so the value is no true mutual
    information where an instance has more than one feature of a template.
    """
    pairs = obs.join(labels, "inst").groupBy("template", "y", "x").agg(F.count("*").alias("n"))

    def h(rows: DataFrame, name: str) -> DataFrame:
        v = F.col("n").cast("double")
        return rows.groupBy("template").agg((F.log(F.sum(v)) - F.sum(v * F.log(v)) / F.sum(v)).alias(name))

    hx = h(pairs.groupBy("template", "x").agg(F.sum("n").alias("n")), "hx")
    hyx = h(pairs, "hyx")
    hy = entropy(labels.groupBy("y").agg(F.count("*").alias("n")), "n").withColumnRenamed("h", "hy")
    out = hx.join(hyx, "template").crossJoin(F.broadcast(hy))  # one row
    return out.withColumn("mi", F.col("hy") + F.col("hx") - F.col("hyx"))


def smoothed_information(df: DataFrame, y: str, x: str, alpha_yx: float = 500.0, alpha: float = 1.0) -> DataFrame:
    """Mutual information of Dirichlet-smoothed counts; pairs never seen share their mass analytically."""
    c = joint_counts(df, y, x)
    dims = c.agg(F.countDistinct("y").alias("ny"), F.countDistinct("x").alias("nx"), F.max("n").alias("n"))
    rows = c.drop("n").crossJoin(F.broadcast(dims))
    cells = F.col("ny") * F.col("nx")
    z = F.col("n") + alpha_yx
    p_y, p_x = (F.col("n_y") + alpha) / (F.col("n") + alpha * F.col("ny")), (F.col("n_x") + alpha) / (F.col("n") + alpha * F.col("nx"))
    p = (F.col("n_yx") + alpha_yx * p_y * p_x) / z
    seen = rows.agg(F.sum(p * F.log(p / (p_y * p_x))).alias("seen"), F.sum(p_y * p_x).alias("mass"), F.max(z).alias("z"), F.max(cells).alias("cells"))
    # a pair never seen has p = alpha_yx * p_y * p_x / z, so its ratio is the same everywhere
    rest = (1 - F.col("mass")) * alpha_yx / F.col("z") * F.log(F.lit(alpha_yx) / F.col("z"))
    return seen.select((F.col("seen") + rest).alias("mi"))


def refined_gain(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """Information gain within every value of ``by``."""
    c = df.groupBy(F.col(by).alias("by"), F.col(y).alias("y"), F.col(x).alias("x")).agg(F.count("*").alias("n_yx"))
    for k in ("y", "x"):
        c = c.withColumn(f"n_{k}", F.sum("n_yx").over(Window.partitionBy("by", k)))
    c = c.withColumn("n", F.sum("n_yx").over(Window.partitionBy("by")))
    value = F.col("n_yx") / F.col("n") * pmi(F.col("n_yx").cast("double"), F.col("n_y"), F.col("n_x"), F.col("n"))
    return c.groupBy("by").agg(F.sum(value).alias("ig"))


def averaged_shards(parts: DataFrame) -> DataFrame:
    """Means of hx, hy, hyx over shards by template, then mi."""
    m = parts.groupBy("template").agg(*[F.avg(c).alias(c) for c in ("hx", "hy", "hyx")])
    return m.withColumn("mi", F.col("hy") + F.col("hx") - F.col("hyx"))


def between_max_and_mean(parts: DataFrame, lam: float) -> DataFrame:
    """lam * max + (1 - lam) * weighted mean of mi over restrictions (template, mi, weight)."""
    mean = F.sum(F.col("mi") * F.col("weight")) / F.sum("weight")
    return parts.groupBy("template").agg((lam * F.max("mi") + (1 - lam) * mean).alias("mi"))


def selectivity(df: DataFrame, feats: str, by: str = "template") -> DataFrame:
    """Share of observations with some feature."""
    return df.groupBy(by).agg(F.avg((F.size(feats) > 0).cast("double")).alias("selectivity"))


def merits(info: DataFrame, sel: DataFrame) -> DataFrame:
    return info.join(sel, "template").withColumn("merit", merit(F.col("mi"), F.col("hx"), F.col("selectivity")))


def feature_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("template", "x").agg(F.count("*").alias("n"))


def cardinality(obs: DataFrame) -> DataFrame:
    return obs.groupBy("template").agg(F.countDistinct("x").alias("cardinality"))


def unseen_rate(obs: DataFrame) -> DataFrame:
    """Leave-one-out share of observations whose feature would be new, by template."""
    return feature_counts(obs).groupBy("template").agg((F.sum((F.col("n") == 1).cast("int")) / F.sum("n")).alias("unseen"))


def total_variance(df: DataFrame, feature: str, values: list[str]) -> DataFrame:
    """Sum of the variances of the columns, by feature."""
    return df.groupBy(feature).agg(sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0])).alias("variance"))


def bub_entropy(counts: DataFrame, by: str, n: str = "n", order: int = 11) -> DataFrame:
    """Entropy by a best-upper-bound polynomial fit of -p log p over binomial counts, per group.

    The coefficients solve a ridge least-squares problem on a grid of p, weighted to
    bound bias over all p; a group is one histogram of counts, not one row an observation.
    """
    hist = counts.groupBy(by, n).agg(F.count("*").alias("m"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c, m = pdf[n].to_numpy(int), pdf["m"].to_numpy(float)
        total = int((c * m).sum())
        a = -(np.arange(total + 1) / total) * np.log(np.maximum(np.arange(total + 1), 1) / total) + 0.5 / total
        a[0] = 0
        k = min(order, total)
        p = np.linspace(0, 1, 200)[1:-1]
        target = -p * np.log(p)
        j = np.arange(k + 1)
        logc = np.cumsum(np.concatenate([[0], np.log(total - j[:-1]) - np.log(j[1:])]))
        b = np.exp(logc[None] + j[None] * np.log(p)[:, None] + (total - j)[None] * np.log1p(-p)[:, None])
        full_j = np.arange(total + 1)
        if total <= 2000:
            lg = np.cumsum(np.concatenate([[0], np.log(total - full_j[:-1]) - np.log(full_j[1:])]))
            rest = np.exp(lg[None] + full_j[None] * np.log(p)[:, None] + (total - full_j)[None] * np.log1p(-p)[:, None])
            fixed = rest[:, k + 1 :] @ a[k + 1 :]
            f = np.maximum(p, 1 / total) ** -0.5
            lhs = (b * f[:, None]).T @ (b * f[:, None]) + 1e-6 * np.eye(k + 1)
            a[: k + 1] = np.linalg.solve(lhs, (b * f[:, None]).T @ ((target - fixed) * f) + 1e-6 * a[: k + 1])
            a[0] = max(0.0, min(a[0], 1 / total))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "h": [float((a[c] * m).sum())]})

    kind = dict(counts.dtypes)[by]
    return hist.groupBy(by).applyInPandas(solve, f"{by} {kind}, h double")
