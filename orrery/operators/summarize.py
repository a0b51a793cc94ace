"""Budgeted selection: summaries, knapsack, diverse greedy choice, divisive clustering, tree distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_cover(has: np.ndarray, length: np.ndarray, weight: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Rows of ``has`` (sentence, concept) whose concepts weigh most in all within the budget, at any number of rows.

    Branch and bound. Where the constraint that a concept needs one of its sentences is
    priced at mu <= weight, a node is worth at most what it covers, the open concepts at
    weight - mu and a fractional knapsack of sentences at mu. Every such mu bounds from
    above; a few subgradient steps bring it near the linear relaxation, and nodes take
    the best of it, mu = weight and all open weights. The time is exponential at worst, never the result.
    """
    plus = np.maximum(weight, 0.0)
    keep = np.flatnonzero(length <= budget)
    keep = keep[np.lexsort((keep, length[keep], -has[keep].sum(1)))]
    if (weight >= 0).all():
        # a sentence is never needed if an earlier one here is as short and covers the same
        x, n, needed = has[keep].astype(np.float32), len(keep), np.ones(len(keep), bool)
        for at in range(0, n, 256):
            within = x[at : at + 256] @ x.T >= x[at : at + 256].sum(1)[:, None]
            within &= (length[keep][None] <= length[keep][at : at + 256, None]) & (np.arange(n)[None] < np.arange(at, min(n, at + 256))[:, None])
            needed[at : at + 256] = ~within.any(1)
        keep = keep[needed]
    has, length = has[keep].astype(float), length[keep]
    size, usable = np.maximum(length, 1e-9), np.ones(len(keep), bool)

    def packed(gain: np.ndarray, live: np.ndarray, room: float) -> tuple[float, np.ndarray]:
        """Fractional knapsack and the share taken of each sentence."""
        taken = np.zeros(len(gain))
        ids = np.flatnonzero(live & (gain > 0))
        ids = ids[np.argsort(-gain[ids] / size[ids], kind="stable")]
        before = np.cumsum(length[ids]) - length[ids]
        taken[ids] = np.clip((room - before) / size[ids], 0.0, 1.0)
        taken[ids[length[ids] == 0]] = 1.0
        return float(gain @ taken), taken

    best, pick = 0.0, []
    used, chosen, open_ = 0, [], np.ones(len(weight))
    while True:  # greedy start
        gain = np.where(usable & (used + length <= budget), has @ (weight * open_), 0.0)
        if not len(gain) or gain.max() <= 0:
            break
        i = int(np.argmax(gain / size))
        chosen.append(i)
        used += length[i]
        open_ = open_ * (1 - has[i])
    if chosen:
        best, pick = float(weight @ (1 - open_)), chosen
    mu, least, price = plus.copy(), np.inf, plus.copy()
    for step in range(60):
        bound, taken = packed(has @ mu, usable, budget)
        bound += float((plus - mu).sum())
        if bound < least - 1e-12:
            least, price = bound, mu.copy()
        slope = has.T @ taken - 1  # of the bound in mu
        if bound <= best or not (norm := float(slope @ slope)):
            break
        mu = np.clip(mu - (bound - best) / norm / (1 + step / 10) * slope, 0.0, plus)
    stack = [(0, np.ones(len(weight)), usable, ())]
    while stack:
        used, open_, live, chosen = stack.pop()
        value = float(weight @ (1 - open_))
        if value > best + 1e-12:
            best, pick = value, list(chosen)
        live = live & (used + length <= budget)
        gain = has @ (plus * open_)
        live = live & (gain > 0)
        if not live.any():
            continue
        reach = float((plus * open_) @ (has[live].max(0)))
        if value + min(reach, packed(gain, live, budget - used)[0]) <= best + 1e-12:
            continue
        priced = packed(has @ (price * open_), live, budget - used)[0] + float(((plus - price) * open_) @ has[live].max(0))
        if value + priced <= best + 1e-12:
            continue
        i = int(np.argmax(np.where(live, gain / size, -1.0)))
        without = live.copy()
        without[i] = False
        stack.append((used, open_, without, chosen))
        stack.append((used + length[i], open_ * (1 - has[i]), without, (*chosen, i)))
    return best, sorted(keep[pick].tolist())


def coverage_summary(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """Sentences whose covered concepts weigh most within a length budget, per group.

    Rows are (by, sent, length, concept, weight); a concept has one weight in a group.
    The choice is exact for groups of every size. A group is the sentences of one entity. Where
    clear_choice() holds, the summary comes from windows; other groups are searched in Python.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pdf["sent"], sort=True, use_na_sentinel=False)
        on, concepts = pd.factorize(pdf["concept"], sort=True, use_na_sentinel=False)
        has, length, weight = np.zeros((len(names), len(concepts)), bool), np.zeros(len(names), np.int64), np.zeros(len(concepts))
        has[at, on], length[at], weight[on] = True, pdf["length"], pdf["weight"]
        columns, same = np.unique(has, axis=1, return_inverse=True)  # concepts of the same sentences are one
        best, pick = best_cover(columns, length, np.bincount(same.reshape(-1), weight), budget)
        return pd.DataFrame({by: pdf[by].iloc[0], "sent": [names[i] for i in pick], "value": best})

    kind = dict(rows.dtypes)
    x = clear_choice(rows.select(by, "sent", "length", "concept", "weight"), by, budget)
    easy = x.where("_clear AND _first AND weight > 0").select(by, "sent", F.col("_value").alias("value"))
    hard = x.where("NOT _clear").select(by, "sent", "length", "concept", "weight")
    return easy.unionByName(hard.groupBy(by).applyInPandas(choose, f"{by} {kind[by]}, sent {kind['sent']}, value double"))


def clear_choice(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """Adds _clear: the group's best summary is all sentences with a weight above 0, and no other set is as good.

    So it is where all sentences fit the budget, no weight is below 0 and no concept above 0
    stands in two sentences. _value is the group's sum of weights then, _first the row of a
    sentence that has its largest weight.
    """
    sentence, concept, group = Window.partitionBy(by, "sent"), Window.partitionBy(by, "concept").orderBy("sent"), Window.partitionBy(by)
    whole = concept.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = rows.withColumn("_once", F.row_number().over(concept) == 1)
    x = x.withColumn("_shared", ~F.first("sent").over(whole).eqNullSafe(F.last("sent").over(whole)) & (F.col("weight") > 0))
    x = x.withColumn("_first", F.row_number().over(sentence.orderBy(F.desc("weight"))) == 1).withColumn("_length", F.max("length").over(sentence))
    unclear = F.col("_shared") | ~F.coalesce((F.col("weight") >= 0) & ~F.isnan("weight") & (F.col("length") >= 0), F.lit(False))
    fits = F.sum(F.when(F.col("_first"), F.col("_length")).otherwise(0)).over(group) <= budget
    x = x.withColumn("_clear", fits & ~F.coalesce(F.max(unclear).over(group), F.lit(True)))
    return x.withColumn("_value", F.sum(F.when(F.col("_once"), F.col("weight")).otherwise(0.0)).over(group).cast("double"))


def mention_costs(rows: DataFrame, cost: float) -> DataFrame:
    """Concept weights lowered by the cost of their mention."""
    return rows.withColumn("weight", F.greatest(F.col("weight") - cost, F.lit(0.0)))


def top_weights(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Weights of all but a group's ``k`` heaviest concepts become 0."""
    w = Window.partitionBy(by).orderBy(F.desc("weight"), "concept")  # rows of a concept are peers
    return rows.dropna(subset=[by, "concept"]).withColumn("_r", F.dense_rank().over(w)).withColumn("weight", F.when(F.col("_r") <= k, F.col("weight")).otherwise(0.0)).drop("_r")


def summaries(sentences: DataFrame, instances: DataFrame, by: str, budget: int, k: int = 1000) -> DataFrame:
    """Sentences that have a verb and do not start with one, joined to their concepts, then the best summary."""
    from ..functions.text import has_main_verb

    kept = sentences.where(has_main_verb(F.col("tags")))
    return coverage_summary(top_weights(kept.join(instances, [by, "sent"]), by, k), by, budget)


def knapsack(items: DataFrame, by: str, item: str, value: str, weight: str, capacity: float, steps: int = 100) -> DataFrame:
    """Items of largest total value whose weights, in ``steps`` parts of the capacity, fit."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        best: list[tuple[float, tuple]] = [(0.0, ())] * (steps + 1)
        for name, v, w in pdf[[item, value, weight]].itertuples(index=False):
            need = max(1, -(-int(w * steps * 1_000_000 / capacity) // 1_000_000))
            for c in range(steps, need - 1, -1):
                if (got := best[c - need][0] + v) > best[c][0] + 1e-12:
                    best[c] = (got, (*best[c - need][1], name))
        return pd.DataFrame({by: pdf[by].iloc[0], item: list(best[steps][1]), "total": best[steps][0]})

    kind = dict(items.dtypes)
    return items.groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, {item} {kind[item]}, total double")


def diverse(items: DataFrame, by: str, item: str, score: str, k: int, discount: float = 0.5, sep: str = "-") -> DataFrame:
    """Greedy choice of ``k`` items; a score falls by its largest name overlap with those chosen."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {n: set(str(n).split(sep)) for n in pdf[item]}
        left = dict(sorted(zip(pdf[item], pdf[score].astype(float), strict=True)))
        out: list = []
        while left and len(out) < k:
            value = {n: s * (1 - discount * max((len(parts[n] & parts[o]) / len(parts[n] | parts[o]) for o in out), default=0.0)) for n, s in left.items()}
            n = max(value, key=value.get)
            out.append(n)
            del left[n]
        return pd.DataFrame({by: pdf[by].iloc[0], item: out, "rank": range(1, len(out) + 1)})

    kind = dict(items.dtypes)
    return items.groupBy(by).applyInPandas(pick, f"{by} {kind[by]}, {item} {kind[item]}, rank long")


def divisive(rows: DataFrame, points: DataFrame, levels: int, value: str, least_gain: float = 1e-8) -> DataFrame:
    """Top-down splits: each level splits every cluster on the feature that lowers its variance most.

    ``rows`` are (key, feat), ``points`` (key, value). Adds cluster: a path of L and R.
    """
    from ..plans.lineage import cut

    state = cut(points.select("key", F.col(value).alias("v")).withColumn("cluster", F.lit("")))
    for _ in range(levels):
        n = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"))
        has = state.join(rows.distinct(), "key").groupBy("cluster", "feat").agg(F.count("*").alias("n1"), F.sum("v").alias("s1"), F.sum(F.col("v") ** 2).alias("q1")).join(n, "cluster").where("n1 < n")
        sse = lambda q, s, c: q - s * s / c
        gain = sse(F.col("q"), F.col("s"), F.col("n")) - sse(F.col("q1"), F.col("s1"), F.col("n1")) - sse(F.col("q") - F.col("q1"), F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
        best = has.withColumn("gain", gain).where(F.col("gain") > least_gain).groupBy("cluster").agg(F.max_by("feat", F.struct(F.round("gain", 9), "feat")).alias("feat"))
        hit = state.join(best, "cluster").join(rows.distinct(), ["key", "feat"], "left_semi").select("key", F.lit(True).alias("left"))
        state = cut(state.join(best, "cluster", "left").join(hit, "key", "left").select("key", "v", F.when(F.col("feat").isNull(), F.col("cluster")).otherwise(F.concat("cluster", F.when(F.col("left"), "L").otherwise("R"))).alias("cluster")))
    return state


def tree_distance(a: tuple[list, list[int]], b: tuple[list, list[int]], ins: float = 1.0, dele: float = 1.0, ren: float = 1.0) -> float:
    """Zhang-Shasha distance of two ordered trees given as labels and parents (root -1), nodes in any order."""

    def post(labels, parents):
        kids: dict[int, list[int]] = {}
        for i, p in enumerate(parents):
            kids.setdefault(p, []).append(i)
        order, first = [], []
        stack = [(r, None) for r in reversed(kids.get(-1, []))]
        while stack:  # children before their parent, from the left
            i, start = stack.pop()
            if start is None:
                stack.append((i, len(order)))
                stack += [(c, None) for c in reversed(kids.get(i, []))]
            else:
                first.append(start)
                order.append(labels[i])
        roots = [i for i in range(len(first)) if first[i] not in first[i + 1 :]]
        return order, first, roots

    (la, fa, ra), (lb, fb, rb) = post(*a), post(*b)
    d = [[0.0] * len(lb) for _ in la]
    for i in ra:
        for j in rb:
            n, m = i - fa[i] + 2, j - fb[j] + 2
            f = [[0.0] * m for _ in range(n)]
            for x in range(1, n):
                f[x][0] = f[x - 1][0] + dele
            for y in range(1, m):
                f[0][y] = f[0][y - 1] + ins
            for x in range(1, n):
                for y in range(1, m):
                    p, q = fa[i] + x - 1, fb[j] + y - 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        f[x][y] = min(f[x - 1][y] + dele, f[x][y - 1] + ins, f[x - 1][y - 1] + (0 if la[p] == lb[q] else ren))
                        d[p][q] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + dele, f[x][y - 1] + ins, f[fa[p] - fa[i]][fb[q] - fb[j]] + d[p][q])
    return d[-1][-1] if la and lb else len(la) * dele + len(lb) * ins


def tree_distances(pairs: DataFrame, normal: bool = False) -> DataFrame:
    """key and distance of pairs (key, labels_a, parents_a, labels_b, parents_b)."""

    def run(batches):
        for pdf in batches:
            out = []
            for la, pa_, lb, pb in pdf[["labels_a", "parents_a", "labels_b", "parents_b"]].itertuples(index=False):
                d = tree_distance((list(la), list(pa_)), (list(lb), list(pb)))
                out.append(d / max(1, len(la) + len(lb)) if normal else d)
            yield pd.DataFrame({"key": pdf["key"], "distance": out})

    return pairs.mapInPandas(run, f"key {dict(pairs.dtypes)['key']}, distance double")
