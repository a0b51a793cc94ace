"""Precision, recall and F1 over sets of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """p, r, f1 of counts; p is 1 without predictions, r is 1 without gold facts."""
    t, p_, n_ = F.col(tp), F.col(fp), F.col(fn)
    p = F.when(t + p_ == 0, 1.0).otherwise(t / (t + p_))
    r = F.when(t + n_ == 0, 1.0).otherwise(t / (t + n_))
    return df.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def marked(gold: DataFrame, pred: DataFrame, key: list[str], nil: Column | None = None) -> DataFrame:
    """Distinct facts with in_gold and in_pred; nil facts are left out."""
    g, p = (d.where(~nil) if nil is not None else d for d in (gold, pred))
    g, p = g.select(*key).distinct().withColumn("in_gold", F.lit(1)), p.select(*key).distinct().withColumn("in_pred", F.lit(1))
    return g.join(p, key, "full_outer").na.fill(0, ["in_gold", "in_pred"])


def counts(m: DataFrame, by: list[str]) -> DataFrame:
    g, p = F.col("in_gold"), F.col("in_pred")
    return m.groupBy(*by).agg(F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"))


def quality(gold: DataFrame, pred: DataFrame, key: list[str], by: list[str], nil: Column | None = None) -> DataFrame:
    """tp, fp, fn, p, r, f1 by some of the key's columns; none of them for the micro value."""
    return ratios(counts(marked(gold, pred, key, nil), by))


def macro(gold: DataFrame, pred: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Means of the values of the groups."""
    return quality(gold, pred, key, by).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("p", "r", "f1")])


def missed(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    return gold.join(pred, key, "left_anti")


def generous(pairs: DataFrame, mode: str) -> Column:
    """Credit of a hypothesis span for a gold span, by mode.

    exact: equal; f1: F1 of tokens; extract_head: gold contains the hypothesis' head;
    expect_head: gold contains the hypothesis' first token, and it has one token.
    """
    gs, ge, hs, he = (F.col(c) for c in ("g_start", "g_end", "h_start", "h_end"))
    both = F.greatest(F.lit(0), F.least(ge, he) - F.greatest(gs, hs))
    size = (ge - gs) + (he - hs)
    return {
        "exact": ((gs == hs) & (ge == he)).cast("double"),
        "f1": F.when(size > 0, 2 * both / size).otherwise(0.0),
        "extract_head": ((gs <= F.col("h_head")) & (F.col("h_head") < ge)).cast("double"),
        "expect_head": ((gs <= hs) & (hs < ge) & (he - hs == 1)).cast("double"),
    }[mode]


def pruning_recall(gold: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """Share of gold spans that pruning keeps, and of kept ones that are gold."""
    return quality(gold, kept, key, [])


def best_so_far(df: DataFrame, by: list[str], order: list, metric: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(metric).over(w)).withColumn("improved", F.col(metric) == F.max(metric).over(w))


def zipped(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold and predicted rows of the same id; an id on one side only raises."""
    g, p = gold.alias("g"), pred.alias("p")
    both = g.join(p, F.col(f"g.{key}") == F.col(f"p.{key}"), "full_outer")
    ok = F.when(F.col(f"g.{key}").isNull() | F.col(f"p.{key}").isNull(), F.raise_error(F.lit("ids differ")).cast("boolean")).otherwise(True)
    return both.where(ok)


def leave_one_out(df: DataFrame, key: list[str]) -> DataFrame:
    """How many other rows share a row's key."""
    return df.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy(*key)) - 1)


def win_rates(judgements: DataFrame) -> DataFrame:
    """(system, wins, games, rate) of (best, middle, worst) judgements: each beats those after it."""
    pair = lambda a, b: F.struct(F.col(a).alias("w"), F.col(b).alias("l"))
    games = judgements.select(F.explode(F.array(pair("best", "middle"), pair("best", "worst"), pair("middle", "worst"))).alias("g"))
    sides = games.select(F.explode(F.array(F.struct(F.col("g.w").alias("system"), F.lit(1).alias("won")), F.struct(F.col("g.l").alias("system"), F.lit(0).alias("won")))).alias("s"))
    out = sides.groupBy("s.system").agg(F.sum("s.won").alias("wins"), F.count("*").alias("games"))
    return out.withColumn("rate", F.col("wins") / F.col("games"))


def best_threshold(scored: DataFrame, score: str, gold: str, parts: int = 64) -> DataFrame:
    """The threshold of largest F1 over all scores, from one pass of running sums; of equals the largest.

    Rows are counted by score first. Distinct scores fall into ``parts`` ranges by
    quantiles; sums run within a range and start from a table of one row a range.
    """
    by = scored.groupBy(F.col(score).alias("t")).agg(F.sum(F.col(gold).cast("int")).alias("pos"), F.count("*").alias("n"))
    edges = sorted(set(by.approxQuantile("t", [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e >= F.col("t").cast("double"))) if edges else F.lit(0)
    by = by.withColumn("part", part)  # 0 holds the largest scores
    sums = by.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"), F.sum("p").over(Window.partitionBy()).alias("all_pos"))
    w = Window.partitionBy("part").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("tp", F.sum("pos").over(w)).withColumn("taken", F.sum("n").over(w)).join(F.broadcast(sums), "part")  # one row a range
    run = run.withColumn("tp", F.col("tp") + F.col("p")).withColumn("taken", F.col("taken") + F.col("m"))
    f1 = 2 * F.col("tp") / (F.col("taken") + F.col("all_pos"))
    return run.withColumn("f1", f1).orderBy(F.desc("f1"), F.desc("t")).limit(1).select("t", "tp", "taken", "f1")


def stopping_step(df: DataFrame, by: list[str], step: str, metric: str, patience: int) -> DataFrame:
    """The first step at which the metric has not risen above its best for ``patience`` steps, null if it never stops."""
    w = Window.partitionBy(*by).orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_n", F.row_number().over(w)).withColumn("_up", F.coalesce(F.col(metric) > F.max(metric).over(upto), F.lit(True)))
    x = x.withColumn("_best", F.max(F.when(F.col("_up"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by).agg(F.min(F.when(F.col("_n") - F.col("_best") >= patience, F.col(step))).alias("stop"))


def step_size(step: Column, rate: float, decay: float) -> Column:
    """Learning rate that falls with the step: rate / (1 + decay * step)."""
    return F.lit(rate) / (1 + decay * step)
