"""Sparse vectors: weighted features (name, weight) in rows or in arrays, tf-idf and cosines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATS = "array<struct<name:string,weight:double>>"


def term_counts(docs: DataFrame, doc: str, words: str) -> DataFrame:
    """doc, term, tf of documents with a word array."""
    return docs.select(F.col(doc).alias("doc"), F.explode(words).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """term, df of (doc, term, tf) rows."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def important_terms(counts: DataFrame, idf: DataFrame, k: int, least: float = 1e-4) -> DataFrame:
    """Each document's ``k`` terms of largest tf * idf, those below ``least`` left out."""
    w = Window.partitionBy("doc").orderBy(F.desc("score"), "term")
    scored = counts.join(idf, "term").withColumn("score", F.col("tf") * F.col("idf")).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def truncated(counts: DataFrame, idf: DataFrame, n: int = 128) -> DataFrame:
    """Term vectors cut to their ``n`` best terms, with counts that fit a byte."""
    return important_terms(counts, idf, n, least=float("-inf")).select("doc", "term", F.least("tf", F.lit(127)).alias("tf"))


def weight(kind: str, tf: Column, idf: Column, temperature: float = 1.0) -> Column:
    """Weights of the cosines: plain tf*sqrt(idf), exp tf*exp(T*sqrt(idf)), hashed tf*idf."""
    if kind == "plain":
        return tf * F.sqrt(idf)
    if kind == "exp":
        return tf * F.exp(temperature * F.sqrt(idf))
    if kind == "hashed":
        return tf * F.coalesce(idf, F.lit(0.0))
    raise ValueError(kind)


def cosine_pairs(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, cosine of the given pairs of (doc, term, w) vectors; 0 without a shared term."""
    norms = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a = weights.select(F.col("doc").alias("a"), "term", F.col("w").alias("wa"))
    b = weights.select(F.col("doc").alias("b"), "term", F.col("w").alias("wb"))
    dot = pairs.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left")
    for k in ("a", "b"):
        out = out.join(norms.select(F.col("doc").alias(k), F.col("norm").alias(f"n{k}")), k, "left")
    z = F.col("na") * F.col("nb")
    return out.select("a", "b", F.when(z > 0, F.coalesce("dot", F.lit(0.0)) / z).otherwise(0.0).alias("cosine"))


def max_exp_weights(counts: DataFrame, pairs: DataFrame, idf: DataFrame, temperature: float = 1.0) -> DataFrame:
    """a, b, side, term, w with w = tf * sqrt(exp(T * idf / maxidf)); the maximum is over both documents of a pair."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("doc")), F.struct(F.lit("b").alias("side"), F.col("b").alias("doc")))).alias("s"))
    rows = sides.select("a", "b", "s.side", "s.doc").join(counts, "doc").join(idf, "term")
    top = F.max("idf").over(Window.partitionBy("a", "b"))
    return rows.select("a", "b", "side", "term", (F.col("tf") * F.sqrt(F.exp(temperature * F.col("idf") / top))).alias("w"))


def pair_cosine(sides: DataFrame) -> DataFrame:
    """a, b, cosine of weights that belong to a pair (a, b, side, term, w)."""
    per = sides.groupBy("a", "b", "term").agg(F.sum(F.when(F.col("side") == "a", F.col("w")).otherwise(0.0)).alias("wa"), F.sum(F.when(F.col("side") == "b", F.col("w")).otherwise(0.0)).alias("wb"))
    agg = per.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sqrt(F.sum(F.col("wa") ** 2)).alias("na"), F.sqrt(F.sum(F.col("wb") ** 2)).alias("nb"))
    return agg.select("a", "b", F.when(F.col("na") * F.col("nb") > 0, F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


# Feature lists in one array column


def feats(names: Column, w: Column | float = 1.0) -> Column:
    """Strings to features of one weight."""
    return F.transform(names, lambda n: F.struct(n.alias("name"), (w if isinstance(w, Column) else F.lit(float(w))).alias("weight")))


def names(fs: Column) -> Column:
    return F.transform(fs, lambda f: f["name"])


def as_map(fs: Column) -> Column:
    """Weights by name, summed."""
    keys = F.array_distinct(names(fs))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(fs, lambda f: f["name"] == k), F.lit(0.0), lambda a, f: a + f["weight"])))


def from_map(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("weight")))


def add(a: Column, b: Column) -> Column:
    """Sum of two vectors by name."""
    return from_map(F.map_zip_with(as_map(a), as_map(b), lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def shared(a: Column, b: Column) -> Column:
    """name and product of the features of both."""
    return F.filter(F.transform(from_map(as_map(a)), lambda f: F.struct(f["name"].alias("name"), (f["weight"] * F.element_at(as_map(b), f["name"])).alias("weight"))), lambda f: f["weight"].isNotNull())


def norm(fs: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(as_map(fs)), F.lit(0.0), lambda a, w: a + w * w))


def cosine(a: Column, b: Column) -> Column:
    """(cos, shared products); 0 if either is 0."""
    both = shared(a, b)
    z = norm(a) * norm(b)
    return F.struct(F.when(z > 0, total(both) / z).otherwise(0.0).alias("cos"), both.alias("shared"))


def total(fs: Column) -> Column:
    return F.aggregate(fs, F.lit(0.0), lambda a, f: a + f["weight"])


def largest(fs: Column) -> Column:
    """Largest weight, 0 at least."""
    return F.aggregate(fs, F.lit(0.0), lambda a, f: F.greatest(a, f["weight"]))


def largest_by_name(fs: Column) -> Column:
    """One feature a name, with its largest weight."""
    keys = F.array_distinct(names(fs))
    return F.transform(keys, lambda k: F.struct(k.alias("name"), F.array_max(F.transform(F.filter(fs, lambda f: f["name"] == k), lambda f: f["weight"])).alias("weight")))


def mean(fs: Column) -> Column:
    return F.when(F.size(fs) > 0, total(fs) / F.size(fs)).otherwise(0.0)


def mapped(fs: Column, f) -> Column:
    return F.transform(fs, lambda x: F.struct(x["name"].alias("name"), f(x["weight"]).alias("weight")))


def scaled(fs: Column, by: float) -> Column:
    return mapped(fs, lambda w: w * by)


def exponential(fs: Column) -> Column:
    return mapped(fs, F.exp)


def product(a: Column, b: Column) -> Column:
    """Weights of equal names multiplied."""
    return shared(a, b)


def by_weight(fs: Column, k: int = 0, magnitude: bool = False) -> Column:
    """Sorted downwards by weight (or its magnitude), then name; the first ``k``, or all if k <= 0."""
    key = (lambda w: -F.abs(w)) if magnitude else (lambda w: -w)
    s = F.array_sort(F.transform(fs, lambda x: F.struct(key(x["weight"]).alias("r"), x["name"].alias("name"), x["weight"].alias("weight"))))
    s = F.slice(s, 1, k) if k > 0 else s
    return F.transform(s, lambda x: F.struct(x["name"].alias("name"), x["weight"].alias("weight")))


def above(fs: Column, eps: float) -> Column:
    return F.filter(fs, lambda x: F.abs(x["weight"]) > eps)


def take(fs: Column, n: int) -> Column:
    return F.slice(fs, 1, n)


def deduplicated(fs: Column) -> Column:
    """One feature a name; weights of a name must agree."""
    keys = F.array_distinct(names(fs))
    own = lambda k: F.array_distinct(F.transform(F.filter(fs, lambda f: f["name"] == k), lambda f: f["weight"]))
    return F.transform(keys, lambda k: F.struct(k.alias("name"), F.when(F.size(own(k)) == 1, own(k)[0]).otherwise(F.raise_error(F.concat(F.lit("weights differ: "), k)).cast("double")).alias("weight")))


def indexed(*lists: Column) -> Column:
    """Several lists as one, weights summed by name."""
    return from_map(as_map(F.concat(*lists)))


def mention_overlap(source: Column, target: Column, scores: Column) -> Column:
    """Sum of scores (a map) of the target's features, repeats included, that the source has."""
    return F.aggregate(F.filter(target, lambda f: F.array_contains(source, f)), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(scores, f), F.lit(0.0)))


def bm_floor(n: int, df: int) -> float:
    """The whole-number idf of one term, for checks."""
    return math.log(n // df)
