"""Semi-naive evaluation of recursive rules, and iterated joins over graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .rules import Program, compile_rule, implied_by


def closure(program: Program, most_rounds: int = 1000) -> dict[str, DataFrame]:
    """All facts the rules give. Each round joins only what the last one found with what is known."""
    known = {k: cut(v.distinct()) for k, v in program.facts.items()}
    spark = next(iter(known.values())).sparkSession
    for r in program.rules:
        if r.head.name not in known:
            sample = compile_rule(r, program.catalog, known) if all(t.name in known for t in r.body) else None
            schema = sample.schema if sample is not None else ", ".join(f"{c} string" for c in program.catalog[r.head.name].columns)
            known[r.head.name] = spark.createDataFrame([], schema)
    delta = dict(known)
    for _ in range(most_rounds):
        fresh: dict[str, list[DataFrame]] = {}
        for r in program.rules:
            for i, t in enumerate(r.body):
                if t.name in delta:
                    fresh.setdefault(r.head.name, []).append(compile_rule(r, program.catalog, known, (i, delta[t.name])))
        delta = {}
        for name, parts in fresh.items():
            new = cut(reduce(DataFrame.union, parts).distinct().join(known[name], list(program.catalog[name].columns), "left_anti"))
            if not new.isEmpty():
                delta[name] = new
        if not delta:
            return known
        for name, new in delta.items():
            known[name] = cut(known[name].union(new))
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def backward(program: Program, goals: dict[str, DataFrame], ignore: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Facts that the goals imply backwards through the rules, transitively."""
    known, delta = dict(goals), dict(goals)
    while delta:
        fresh: dict[str, DataFrame] = {}
        for r in program.rules:
            if r.head.name in delta:
                for name, df in implied_by(r, delta[r.head.name], program.catalog).items():
                    if name not in ignore:
                        fresh[name] = fresh[name].union(df) if name in fresh else df
        delta = {}
        for name, df in fresh.items():
            new = cut(df.distinct().join(known[name], df.columns, "left_anti") if name in known else df.distinct())
            if not new.isEmpty():
                delta[name] = new
                known[name] = known[name].union(new) if name in known else new
    return known


def k_hop(edges: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """All simple paths of at most ``k`` edges as (start, end, hops, path)."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct()
    step = e.select(F.col("s").alias("start"), F.col("d").alias("end"), F.array("s", "d").alias("path"))
    out = step
    for _ in range(k - 1):
        step = step.join(e, step.end == e.s).where(~F.array_contains("path", F.col("d"))).select("start", F.col("d").alias("end"), F.concat("path", F.array("d")).alias("path"))
        out = out.union(step)
    return out.select("start", "end", (F.size("path") - 1).alias("hops"), "path")


def shortest_hops(edges: DataFrame, sources: DataFrame, src: str = "src", dst: str = "dst", most: int = 1000) -> DataFrame:
    """(start, node, hops) by breadth-first rounds from the nodes in ``sources`` (node)."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    seen = cut(sources.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct())
    front = seen
    for hop in range(1, most + 1):
        front = cut(front.join(e, "node").select("start", F.col("next").alias("node"), F.lit(hop).alias("hops")).distinct().join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def random_walk(edges: DataFrame, source, restart: float = 0.1, rounds: int = 10, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """(node, mass) after ``rounds`` of b = restart * e_source + (1 - restart) * P'b; mass at dead ends returns to the source."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.groupBy(F.col(src).alias("node"), F.col(dst).alias("next")).agg(F.sum(w).alias("w"))
    e = cut(e.join(e.groupBy("node").agg(F.sum("w").alias("z")), "node").select("node", "next", (F.col("w") / F.col("z")).alias("p")))
    mass = edges.sparkSession.createDataFrame([(source, 1.0)], edges.select(F.col(src).alias("node"), F.lit(1.0).alias("mass")).schema)
    start = mass.select("node")
    for _ in range(rounds):
        moved = mass.join(e, "node", "left")
        spread = moved.where("next IS NOT NULL").select(F.col("next").alias("node"), ((1 - restart) * F.col("mass") * F.col("p")).alias("mass"))
        lost = moved.where("next IS NULL").agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("lost"))
        back = start.crossJoin(lost).select("node", (F.lit(restart) + (1 - restart) * F.col("lost")).alias("mass"))
        mass = cut(spread.union(back).groupBy("node").agg(F.sum("mass").alias("mass")))
    return mass
