"""Feature templates: names to columns, products, alphabets, frequency transforms.

A template is a Column of array<string>: the strings it extracts from a row, empty if
none. Rows have ``tokens`` (array of struct with word, lemma, pos, head, deprel, ...),
and spans ``target`` and ``arg`` (start, end).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import digest_hash, span_relation


def one(col: Column) -> Column:
    """A single extracted string, or nothing for null."""
    return F.when(col.isNull(), F.array().cast("array<string>")).otherwise(F.array(col.cast("string")))


def token(at: Column) -> Column:
    """The token at a place; null outside of the sentence."""
    return F.when(at >= 0, F.get(F.col("tokens"), at))


def shape(word: Column) -> Column:
    """Letters to X and x, digits to d, runs cut to two."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\d", "d")
    return F.regexp_replace(s, r"(.)\1{2,}", "$1$1")


#: How a token is shown.
VIEWS = {
    "Word": lambda t: t["word"], "WordLC": lambda t: F.lower(t["word"]), "Word3": lambda t: F.substring(t["word"], 1, 3), "Word4": lambda t: F.substring(t["word"], 1, 4),
    "Lemma": lambda t: t["lemma"], "Pos": lambda t: t["pos"], "Pos2": lambda t: F.substring(t["pos"], 1, 2), "Shape": lambda t: shape(t["word"]),
    "BasicLabel": lambda t: t["deprel"], "ParentDir": lambda t: F.when(t["head"] < 0, "root").otherwise("dep"),
}

#: Which token of a span is looked at.
PLACES = {
    "Head": lambda s, h: h, "First": lambda s, h: s["start"], "Last": lambda s, h: s["end"] - 1, "Left": lambda s, h: s["start"] - 1, "Right": lambda s, h: s["end"],
    "ToLeft": lambda s, h: h - 1, "ToRight": lambda s, h: h + 1, "Parent": lambda s, h: token(h)["head"], "Grandparent": lambda s, h: token(token(h)["head"])["head"],
}


def head(span: Column) -> Column:
    """First token of a span whose head lies outside of it."""
    inside = F.filter(F.sequence(span["start"], span["end"] - 1), lambda i: (token(i)["head"] < span["start"]) | (token(i)["head"] >= span["end"]))
    return F.coalesce(F.get(inside, F.lit(0)), span["start"])


def basic_templates() -> dict[str, Column]:
    """Target and argument by place and view, and relations of the two."""
    out: dict[str, Column] = {}
    for prefix, col in (("Span1", F.col("target")), ("Span2", F.col("arg"))):
        h = head(col)
        for place, where in PLACES.items():
            at = where(col, h)
            for view, show in VIEWS.items():
                out[f"{prefix}-{place}-{view}"] = one(show(token(at)))
        out[f"{prefix}-Width"] = one(F.least(col["end"] - col["start"], F.lit(10)))
        out[f"{prefix}-Child-BasicLabel"] = F.transform(F.filter("tokens", lambda t: t["head"] == h), lambda t: t["deprel"])
    out["Span1-Span2-Relation"] = one(span_relation(F.col("target"), F.col("arg")))
    out["Span1-Span2-Distance"] = one(F.least(F.abs(F.col("target.start") - F.col("arg.start")), F.lit(20)))
    for label in ("frame", "role"):
        out[label] = one(F.col(label))
    out["frameRole"] = one(F.concat(F.col("frame"), F.lit("."), F.col("role")))
    out["1"] = F.array(F.lit("1"))
    return out


def product(a: Column, b: Column, sep: str = "_") -> Column:
    """Every string of ``a`` joined to every string of ``b``; nothing if either has none."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(sep), y))))


def pruned_product(a: Column, b: Column, seed: int = 1) -> Column:
    """Product joined by "." whose right side keeps 20 + 2 * sqrt(n) strings, drawn by hash."""
    keep = (F.lit(20) + 2 * F.sqrt(F.size(b))).cast("int")
    drawn = F.transform(F.slice(F.array_sort(F.transform(b, lambda y: F.struct(F.xxhash64(y, F.lit(seed)).alias("h"), y.alias("y")))), F.lit(1), keep), lambda s: s["y"])
    return product(a, drawn, ".")


def parse(text: str) -> list[list[str]]:
    """``a*b + c*d`` as a list of products of names."""
    out = [[n.strip() for n in p.split("*")] for p in text.split("+")]
    if any(not n for p in out for n in p):
        raise ValueError(f"empty template name in {text!r}")
    return out


def compiled(text: str, templates: Mapping[str, Column]) -> dict[str, Column]:
    """Every product of the text as one column."""
    out = {}
    for p in parse(text):
        if missing := [n for n in p if n not in templates]:
            raise KeyError(f"no such templates: {missing}")
        out["*".join(p)] = reduce(product, [templates[n] for n in p])
    return out


def extracted(df: DataFrame, keys: list[str], features: Mapping[str, Column]) -> DataFrame:
    """keys, template, x: one row an extracted string."""
    arrays = F.array(*[F.struct(F.lit(n).alias("template"), c.alias("xs")) for n, c in features.items()])
    return df.select(*keys, F.explode(arrays).alias("t")).select(*keys, "t.template", F.explode("t.xs").alias("x"))


def alphabet(obs: DataFrame) -> DataFrame:
    """(template, x, t, f): dense numbers of templates and, within each, of strings."""
    distinct = obs.select("template", "x").distinct()
    names = distinct.select("template").distinct().withColumn("t", F.row_number().over(Window.orderBy("template")) - 1)  # templates are few
    f = F.row_number().over(Window.partitionBy("template").orderBy("x")) - 1
    return distinct.withColumn("f", f).join(F.broadcast(names), "template")


def indexed(obs: DataFrame, alph: DataFrame, frozen: bool = True) -> DataFrame:
    """Observations as numbers; strings not in the alphabet get -1, or are dropped if not ``frozen``."""
    out = obs.join(alph, ["template", "x"], "left" if frozen else "inner")
    return out.withColumn("t", F.coalesce("t", F.lit(-1))).withColumn("f", F.coalesce("f", F.lit(-1)))


def hashed(x: Column, dims: int, portable: bool = False) -> Column:
    """A string's number among ``dims``; ``portable`` takes a digest that any engine can repeat."""
    return F.pmod(digest_hash(x, 60) if portable else F.xxhash64(x), F.lit(dims))


def flat_index(values: list[Column], cards: list[int]) -> Column:
    """One number for a tuple of feature numbers, in mixed radix."""
    out = F.lit(0).cast("long")
    for v, c in zip(values, cards, strict=True):
        out = out * c + v
    return out


def unflat_index(index: Column, cards: list[int]) -> list[Column]:
    """The inverse of flat_index()."""
    out = []
    for c in reversed(cards):
        out.append((index % c).cast("int"))
        index = F.floor(index / c)
    return out[::-1]


def merged_alphabets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge on (strT, strF) with shared new numbers, and the numbers each side had (-1 if none).

    Tails of both sides are kept.
    """
    x = a.select("strT", "strF", F.col("newT").alias("oldT_a"), F.col("newF").alias("oldF_a"))
    y = b.select("strT", "strF", F.col("newT").alias("oldT_b"), F.col("newF").alias("oldF_b"))
    both = x.join(y, ["strT", "strF"], "full_outer").na.fill(-1, ["oldT_a", "oldF_a", "oldT_b", "oldF_b"])
    names = both.select("strT").distinct().withColumn("newT", F.row_number().over(Window.orderBy("strT")) - 1)  # templates are few
    return both.join(F.broadcast(names), "strT").withColumn("newF", F.row_number().over(Window.partitionBy("strT").orderBy("strF")) - 1)


def common_alphabet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner merge on the strings."""
    return a.join(b.select("strT", "strF"), ["strT", "strF"], "left_semi")


def projected(features: DataFrame, bialph: DataFrame, keys: list[str]) -> DataFrame:
    """Features (array of t, f) renumbered by (oldT, oldF) -> (newT, newF); unknown ones are dropped."""
    rows = features.select(*keys, F.explode("feats").alias("p")).select(*keys, F.col("p.t").alias("oldT"), F.col("p.f").alias("oldF"))
    out = rows.join(bialph.select("oldT", "oldF", "newT", "newF"), ["oldT", "oldF"])
    return out.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("newT").alias("t"), F.col("newF").alias("f")))).alias("feats"))


def templates_in(alph: DataFrame, names: list[str]) -> DataFrame:
    return alph.where(F.col("strT").isin(*names))


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """Each template's ``k`` most frequent strings."""
    w = Window.partitionBy("template").orderBy(F.desc("n"), "x")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def at_least(counts: DataFrame, k: int) -> DataFrame:
    return counts.where(F.col("n") >= k)


def restricted(obs: DataFrame, kept: DataFrame) -> DataFrame:
    """Observations whose string is among the kept ones."""
    return obs.join(kept.select("template", "x"), ["template", "x"], "left_semi")
