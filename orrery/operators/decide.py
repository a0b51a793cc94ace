"""Decisions per group of candidates, priorities and the scored agenda.

Candidates are popped by priority downwards; ties go by the key given as ``tie``, so
every operator has one result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEC = re.compile(r"(\w+):([\w-]+)\(([^)]*)\)((?::\w+)*)|(\w+):([\w-]+)((?::\w+)*)")


def popped(by: list[str], prio: str, tie: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc(prio), *tie)


def at_least_one(by: list[str], prio: str, score: str, tie: list[str]) -> Column:
    return (F.row_number().over(popped(by, prio, tie)) == 1) | (F.col(score) > 0)


def at_most_one(by: list[str], prio: str, score: str, tie: list[str]) -> Column:
    """The first candidate with a positive score."""
    hit = F.when(F.col(score) > 0, 1).otherwise(0)
    before = F.sum(hit).over(popped(by, prio, tie).rowsBetween(Window.unboundedPreceding, 0))
    return (hit == 1) & (before == 1)


def exactly_one(by: list[str], prio: str, score: str, tie: list[str]) -> Column:
    return F.row_number().over(popped(by, prio, tie)) == 1


MODES: dict[str, Callable[..., Column]] = {"AT_LEAST_ONE": at_least_one, "AT_MOST_ONE": at_most_one, "EXACTLY_ONE": exactly_one}


def parse_spec(text: str) -> tuple[str, str, list[str], list[str]]:
    """``MODE:rel(args):k1:k2`` as mode, relation, arguments and key arguments."""
    m = SPEC.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a decision: {text!r}")
    mode, rel, args, keys = (m[1], m[2], m[3], m[4]) if m[1] else (m[5], m[6], "", m[7])
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    own = [a.strip() for a in args.split(",") if a.strip()]
    key = [k for k in keys.split(":") if k]
    if own and (loose := [k for k in key if k not in own]):
        raise ValueError(f"not arguments of {rel}: {loose}")
    return mode, rel, own, key


def threshold(score: str, c: float) -> Column:
    return F.col(score) > c


def by_relation(rel: str, decisions: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = None
    for name, d in decisions.items():
        out = F.when(F.col(rel) == name, d) if out is None else out.when(F.col(rel) == name, d)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None).cast("boolean"))


def cascade(*decisions: Column) -> Column:
    """The first decision that is made."""
    return F.coalesce(*decisions)


def unanimous(*decisions: Column) -> Column:
    """All decisions that are made must agree."""
    made = F.array_distinct(F.filter(F.array(*decisions), lambda d: d.isNotNull()))
    return F.when(F.size(made) > 1, F.raise_error(F.lit("decisions differ")).cast("boolean")).otherwise(F.get(made, F.lit(0)))


def double_at_most_one(df: DataFrame, doc: str, key_a: str, key_b: str, prio: str, score: str, tie: str) -> DataFrame:
    """Accepts while both keys are free: a greedy matching in pop order, one document at a time."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([prio, tie], ascending=[False, True], kind="stable")
        used_a, used_b, out = set(), set(), []
        for a, b, s in zip(pdf[key_a], pdf[key_b], pdf[score], strict=True):
            ok = s > 0 and a not in used_a and b not in used_b
            if ok:
                used_a.add(a)
                used_b.add(b)
            out.append(ok)
        return pdf.assign(accepted=out)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.groupBy(doc).applyInPandas(match, f"{fields}, accepted boolean")


def out_of_order(df: DataFrame, by: list[str], order: list, score: str) -> DataFrame:
    """Rows whose score is above the one before in their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(score).over(w)).where(F.col(score) > F.col("previous"))


def running_quality(df: DataFrame, by: list[str], prio: str, gold: str, tie: list[str]) -> DataFrame:
    """tp, fp, step, precision and recall after each pop."""
    w = popped(by, prio, tie).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(gold).cast("int")
    out = df.withColumn("tp", F.sum(hit).over(w)).withColumn("fp", F.sum(1 - hit).over(w)).withColumn("step", F.count(F.lit(1)).over(w))
    total = F.sum(hit).over(Window.partitionBy(*by))
    return out.withColumn("precision", F.col("tp") / F.col("step")).withColumn("recall", F.when(total > 0, F.col("tp") / total).otherwise(1.0))


#: Sums of doubles in nodes of FAN rows, LEVELS times, and of whole groups in runs of RUN rows.
FAN, LEVELS, RUN = 16, 4, 2048


def block_sums(df: DataFrame, by: list[str], order: list, w: str) -> DataFrame:
    """``df`` with _before and _total, the sums of the rows before and of all rows of the group, added in blocks.

    A running sum of doubles errs by as many roundings as it has rows. Here a node holds the
    sum of FAN rows, and a node of the next level that of FAN nodes; the sum before a row
    starts with the whole nodes of the highest level and goes down to single rows. The total
    adds runs of RUN rows. So does the engine that the SQL is held against (its runs may
    begin elsewhere), so that shares as near to a bound as doubles tell apart fall on the
    same side. All windows lie within one exchange by ``by``.
    """
    place = F.col("_place")
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)

    def within(size: int | None, last: int = Window.currentRow) -> Window:
        group = [] if size is None else [F.floor(place / size)]
        return Window.partitionBy(*by, *group).orderBy("_place").rowsBetween(Window.unboundedPreceding, last)

    df = df.withColumn("_s0", F.col(w).cast("double"))
    for k in range(1, LEVELS + 1):  # a node's sum stands in its last row
        df = df.withColumn(f"_s{k}", F.when((place + 1) % FAN**k == 0, F.sum(f"_s{k - 1}").over(within(FAN**k))))
    one_up = Window.partitionBy(*by).orderBy("_place")
    df = df.withColumns({f"_s{k}": F.lag(f"_s{k}").over(one_up) for k in range(LEVELS + 1)} | {"_end": F.lead("_place").over(one_up).isNull() | ((place + 1) % RUN == 0)})
    df = df.withColumn("_before", F.when(place == 0, F.lit(0.0)))
    for k in range(LEVELS, -1, -1):  # what is before a node stands in its first row; the first of its siblings starts from the node above
        first = place == 0 if k == LEVELS else place % FAN ** (k + 1) == 0
        step = F.when(place % FAN**k == 0, F.when(first, F.col("_before")).otherwise(F.col(f"_s{k}")))
        df = df.withColumn("_step", step).withColumn("_before", F.sum("_step").over(within(None if k == LEVELS else FAN ** (k + 1))))
    df = df.withColumn("_run", F.when(F.col("_end"), F.sum(F.col(w).cast("double")).over(within(RUN))))
    df = df.withColumn("_total", F.sum("_run").over(within(None, Window.unboundedFollowing)))
    return df.drop("_place", "_step", "_run", "_end", *[f"_s{k}" for k in range(LEVELS + 1)])


def mass_prefix(df: DataFrame, by: list[str], w: str, ratio: float, tie: list[str]) -> DataFrame:
    """The shortest prefix by weight whose share reaches ``ratio``; the row that crosses it stays."""
    if df.schema[w].dataType.typeName() in ("double", "float"):
        df = block_sums(df, by, [F.desc(w), *tie], w)
    else:  # sums are exact
        before = F.sum(w).over(popped(by, w, tie).rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum(w).over(Window.partitionBy(*by))})
    return df.where(F.col("_before") / F.col("_total") < ratio).drop("_before", "_total")


def two_sided(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """lt and gt: rows of the group with values up to, and from, the row's own; n of the group."""
    up, down = Window.partitionBy(*by).orderBy(v), Window.partitionBy(*by).orderBy(F.desc(v))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("n", n).withColumn("lt", F.round(F.cume_dist().over(up) * n).cast("long")).withColumn("gt", F.round(F.cume_dist().over(down) * n).cast("long"))


def recent(df: DataFrame, by: list[str], order: list, v: str, n: int) -> DataFrame:
    """Mean and variance of the last ``n`` values, and the values themselves."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n + 1, 0)
    return df.withColumn("mean", F.avg(v).over(w)).withColumn("variance", F.var_pop(v).over(w)).withColumn("last", F.collect_list(v).over(w))


def moving_average(values: Column, history: float) -> Column:
    """Exponential average of an array: history * old + (1 - history) * new, from the first value on."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x.cast("double")).otherwise(history * a + (1 - history) * x))


# Priorities

#: Rank of a relation in depth-first order.
STAGE_RANKS = {"event1": -2.0, "predicate2": -1.0, "srl2": 0.0, "srl3": 1.0, "argument4": 2.0}


def stage_rank(rel: str, ranks: dict[str, float] | None = None, breadth: bool = False) -> Column:
    out = F.lit(0.0)
    for name, r in (ranks or STAGE_RANKS).items():
        out = F.when(F.col(rel) == name, -r if breadth else r).otherwise(out)
    return out


def left_right(ends: list[Column]) -> Column:
    return -F.greatest(*ends) / 5 if len(ends) > 1 else -ends[0] / 5


def start_then_width(start: Column, width: Column) -> Column:
    return -(start + F.floor(width / 1000))


def end_then_width(end: Column, width: Column) -> Column:
    return -(end + F.floor(width / 1000))


def row_share(by: list[str], order: list) -> Column:
    """A row's number from 0, divided by the rows."""
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def name_rank(role: Column, chars: int = 8) -> Column:
    """1 minus the name read as a fraction of base 256."""
    out = F.lit(1.0)
    for i in range(chars):
        out = out - F.coalesce(F.ascii(F.substring(role, i + 1, 1)), F.lit(0)) / float(256 ** (i + 1))
    return out


def parse_priority(text: str) -> list[tuple[float, str]]:
    """``0.5*easyfirst+1*dfs`` as weights and names."""
    out = []
    for part in text.split("+"):
        w, star, name = part.strip().rpartition("*")
        out.append((float(w) if star else 1.0, name.strip()))
    return out


def weighted(text: str, named: dict[str, Column]) -> Column:
    """The weighted sum that a priority text means."""
    parts = [w * named[n] for w, n in parse_priority(text)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def beam(df: DataFrame, by: list[str], score: str, k: int, tie: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(popped(by, score, tie))).where(F.col("rank") <= k)


# The agenda with rescoring


class Agenda:
    """Priority queue of candidates with removal and rescoring; ties pop the least key."""

    def __init__(self):
        self._heap: list[tuple[float, object, int]] = []
        self._live: dict[object, tuple[float, int]] = {}
        self._clock = 0

    def __len__(self) -> int:
        return len(self._live)

    def __contains__(self, key: object) -> bool:
        return key in self._live

    def add(self, key: object, priority: float) -> None:
        """Adds or rescores."""
        self._clock += 1
        self._live[key] = (priority, self._clock)
        heapq.heappush(self._heap, (-priority, key, self._clock))

    def remove(self, key: object) -> bool:
        return self._live.pop(key, None) is not None

    def peek(self) -> tuple[object, float]:
        while True:
            p, key, at = self._heap[0]
            if self._live.get(key, (None, None))[1] == at:
                return key, -p
            heapq.heappop(self._heap)

    def pop(self) -> tuple[object, float]:
        key, p = self.peek()
        heapq.heappop(self._heap)
        del self._live[key]
        return key, p


def agenda_inference(df: DataFrame, doc: str, key: str, score: str, group: str, penalty: float, accept: float = 0.0, oracle: str | None = None) -> DataFrame:
    """Pops candidates by score; each accepted one lowers the pending ones of its group by ``penalty``.

    With ``oracle`` a candidate is accepted iff its gold mark is set. One document is one
    group of candidates, which is what has to fit in memory. Adds step, final and accepted.
    """
    gold = oracle

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        agenda = Agenda()
        rows = {k: i for i, k in enumerate(pdf[key])}
        groups: dict = {}
        marks = pdf[gold].tolist() if gold else []
        for k, s, g in zip(pdf[key], pdf[score], pdf[group], strict=True):
            if k not in agenda:
                agenda.add(k, float(s))
                groups.setdefault(g, []).append(k)
        of, done = pdf[group].tolist(), {}
        current = dict(zip(pdf[key], pdf[score].astype(float), strict=True))
        while len(agenda):
            k, p = agenda.pop()
            ok = bool(marks[rows[k]]) if gold else p > accept
            done[k] = (len(done), p, ok)
            if ok:
                for other in groups[of[rows[k]]]:
                    if other in agenda:
                        current[other] -= penalty
                        agenda.add(other, current[other])
        out = pdf.drop_duplicates(key)
        step, final, ok = zip(*(done[k] for k in out[key]), strict=True)
        return out.assign(step=list(step), final=list(final), accepted=list(ok))

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.groupBy(doc).applyInPandas(infer, f"{fields}, step long, final double, accepted boolean")


def global_features(args: DataFrame, by: list[str], role: str) -> tuple[DataFrame, DataFrame]:
    """Number of chosen arguments by frame instance, and the pairs of roles that occur together."""
    n = args.groupBy(*by).agg(F.count("*").alias("n_args"))
    a, b = args.select(*by, F.col(role).alias("role_a")), args.select(*by, F.col(role).alias("role_b"))
    return n, a.join(b, by).where("role_a < role_b").groupBy("role_a", "role_b").agg(F.count("*").alias("n"))
