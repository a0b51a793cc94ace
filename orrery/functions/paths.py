"""Dependency paths over token arrays with a ``head`` (-1 at the root), all in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH = 10_000


def chain(tokens: Column, at: Column, most: int = MOST_DEPTH) -> Column:
    """A token and its ancestors, up to the root."""
    start = F.array(at.cast("int"))
    step = lambda acc, _: F.when(F.get(tokens, F.element_at(acc, -1))["head"] >= 0, F.concat(acc, F.array(F.get(tokens, F.element_at(acc, -1))["head"]))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(most), F.size(tokens))), start, step)


def rounds(tokens: Column) -> Column:
    """Enough doublings for a chain through all tokens."""
    return F.sequence(F.lit(1), F.ceil(F.log2(F.size(tokens) + 1)).cast("int") + 1)


def depths(tokens: Column) -> Column:
    """Distance of every token from the root, by pointers that double their reach; the number of tokens on a cycle."""
    start = F.transform(tokens, lambda t: F.struct(F.coalesce(t["head"], F.lit(-1)).cast("int").alias("up"), F.when(t["head"] >= 0, 1).otherwise(0).alias("far")))
    end = F.struct(F.lit(-1).alias("up"), F.lit(0).alias("far"))

    def double(acc, _):
        def further(s):
            to = F.coalesce(F.when(s["up"] >= 0, F.get(acc, s["up"])), end)
            return F.struct(to["up"].alias("up"), (s["far"] + to["far"]).alias("far"))

        return F.transform(acc, further)

    return F.transform(F.aggregate(rounds(tokens), start, double), lambda s: F.least(s["far"], F.size(tokens)))


def tree_path(tokens: Column, a: Column, b: Column) -> Column:
    """up (from a to the common ancestor) and down (from below it to b); null without one."""

    def meet(s):
        x, y = s["x"], s["y"]
        top = F.get(F.filter(x, lambda i: F.array_contains(y, i)), F.lit(0))
        up = F.slice(x, F.lit(1), F.array_position(x, top).cast("int"))
        down = F.reverse(F.slice(y, F.lit(1), F.greatest(F.array_position(y, top).cast("int") - 1, F.lit(0))))
        return F.when(top.isNotNull(), F.struct(up.alias("up"), down.alias("down")))

    return F.get(F.transform(F.array(F.struct(chain(tokens, a).alias("x"), chain(tokens, b).alias("y"))), meet), F.lit(0))


def path_text(tokens: Column, a: Column, b: Column, show: str = "deprel", most: int = 20) -> Column:
    """Labels up ("<") and down (">") a path; null if it is longer than ``most``."""
    p = tree_path(tokens, a, b)
    up = F.transform(F.slice(p["up"], F.lit(1), F.size(p["up"]) - 1), lambda i: F.concat(F.get(tokens, i)[show], F.lit("<")))
    down = F.transform(p["down"], lambda i: F.concat(F.lit(">"), F.get(tokens, i)[show]))
    return F.when(F.size(up) + F.size(down) <= most, F.array_join(F.concat(up, down), ""))


def path_grams(labels: Column, n: int) -> Column:
    """Runs of ``n`` labels of a path, padded by its ends."""
    padded = F.concat(F.array(F.lit("^")), labels, F.array(F.lit("$")))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(padded) - n, F.lit(0))), lambda i: F.array_join(F.slice(padded, i + 1, n), " "))


def attribute_paths(tokens: Column, name: Column, hops: int = 3) -> Column:
    """(path, backoff, end) from a name's head to names, numbers and adjectives at most ``hops`` away."""
    ends = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i != name) & F.get(tokens, i)["pos"].rlike("^(NNP|CD|JJ)"))
    rows = F.transform(ends, lambda i: F.struct(path_text(tokens, name, i, most=hops).alias("path"), F.get(tokens, i)["pos"].alias("backoff"), i.alias("end")))
    return F.filter(rows, lambda r: r["path"].isNotNull())


def subtree(tokens: Column, at: Column) -> Column:
    """The span of a token and all it governs."""
    at = at.cast("int")
    start = F.transform(tokens, lambda t, i: F.when((i == at) | F.coalesce(t["head"] < 0, F.lit(True)), i).otherwise(t["head"].cast("int")))
    top = F.aggregate(rounds(tokens), start, lambda acc, _: F.transform(acc, lambda p: F.coalesce(F.get(acc, p), p)))
    own = F.filter(F.transform(top, lambda p, i: F.when(p == at, i)), lambda i: i.isNotNull())
    return F.struct(F.array_min(own).alias("start"), (F.array_max(own) + 1).alias("end"))


def noun_phrase(tokens: Column, at: Column, labels: tuple[str, ...] = ("det", "amod", "compound", "nn", "poss", "nummod", "num")) -> Column:
    """The span of a noun with its modifiers next to it."""
    near = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i == at) | ((F.get(tokens, i)["head"] == at) & F.get(tokens, i)["deprel"].isin(*labels)))
    return F.struct(F.array_min(near).alias("start"), (F.array_max(near) + 1).alias("end"))


def passive(tokens: Column, verb: Column) -> Column:
    """Whether a verb has a passive subject or auxiliary."""
    return F.exists(tokens, lambda t: (t["head"] == verb) & t["deprel"].isin("nsubjpass", "auxpass", "csubjpass", "nsubj:pass", "aux:pass"))


def lacks_subject(tokens: Column, verb: Column) -> Column:
    return ~F.exists(tokens, lambda t: (t["head"] == verb) & t["deprel"].rlike("subj"))


def dependents(tokens: Column, verb: Column) -> Column:
    """Sorted labels of a token's dependents."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t["head"] == verb), lambda t: t["deprel"])))


def argument_spans(tokens: Column, target: Column, mode: str) -> Column:
    """Candidate argument spans: ``dependency`` (all subtrees), ``xue_palmer`` (dependents of the target and of its ancestors), ``all`` short spans."""
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    if mode == "dependency":
        return F.array_distinct(F.transform(every, lambda i: subtree(tokens, i)))
    if mode == "xue_palmer":
        up = chain(tokens, target)
        return F.array_distinct(F.transform(F.filter(every, lambda i: F.array_contains(up, F.get(tokens, i)["head"]) & ~F.array_contains(up, i)), lambda i: subtree(tokens, i)))
    if mode == "all":
        return F.flatten(F.transform(every, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.size(tokens) - i)), lambda n: F.struct(i.alias("start"), (i + n).alias("end")))))
    raise ValueError(mode)
