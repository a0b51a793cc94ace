"""Smaller operators: intersections, lookups, merges, products, naive Bayes, set hashes, line maps."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.infogain import template_information
from ..functions.text import STOP_FEATURES


def entity_mentions(mentions: DataFrame) -> DataFrame:
    """Typed mentions of one type without tabs."""
    t = F.col("types")
    return mentions.where((F.size(F.array_distinct(t)) == 1) & (t[0] != "O") & ~F.col("mention").contains("\t"))


def searchable(features: DataFrame, feat: str = "feat") -> DataFrame:
    return features.where(~F.col(feat).isin(*STOP_FEATURES))


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both lists, each once."""
    return a.select(key).intersect(b.select(key))


def merge_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sorted lists; a key repeated on both sides pairs up, so it comes min times."""
    n = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    both = n(a, "x").join(n(b, "y"), key)
    return both.select(key, F.explode(F.sequence(F.lit(1), F.least("x", "y"))).alias("_i")).select(key)


def documents_of_tokens(tokens: DataFrame, t2c: DataFrame) -> DataFrame:
    return tokens.join(t2c, "tok")


def words_of_documents(docs: DataFrame, c2w: DataFrame) -> DataFrame:
    """One map of words a document."""
    own = c2w.join(docs.select("comm").distinct(), "comm", "left_semi")
    return own.groupBy("comm").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("cnt").cast("int")))).alias("words"))


def attached(documents: DataFrame, facts: DataFrame, doc: str) -> DataFrame:
    """Documents with their sentences' facts."""
    own = facts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("sent", "rel", "args"))).alias("facts"))
    return documents.join(own, doc, "left")


def merged_by_sentence(sentences: DataFrame, instances: DataFrame, key: str = "sent") -> DataFrame:
    """Sentences with all their instances, none if they have none."""
    own = instances.groupBy(key).agg(F.collect_list(F.struct(*[c for c in instances.columns if c != key])).alias("instances"))
    return sentences.join(own, key, "left")


def product_information(obs: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Information of products of two templates (a, b), from observations (inst, template, x)."""
    x = obs.select("inst", F.col("template").alias("a"), F.col("x").alias("xa"))
    y = obs.select("inst", F.col("template").alias("b"), F.col("x").alias("xb"))
    prod = x.join(F.broadcast(pairs), "a").join(y, ["inst", "b"])  # pairs of template names
    return template_information(prod.select("inst", F.concat_ws("*", "a", "b").alias("template"), F.concat_ws("_", "xa", "xb").alias("x")), labels)


def naive_bayes(train: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Log priors (y, prior) and log likelihoods (y, x, ll) of (inst, y, x) rows, smoothed by ``alpha``."""
    n = train.select("inst", "y").distinct().groupBy("y").agg(F.count("*").alias("n"))
    prior = n.withColumn("prior", F.log(F.col("n") / F.sum("n").over(Window.partitionBy()))).select("y", "prior")  # labels are few
    c = train.groupBy("y", "x").agg(F.count("*").alias("c"))
    vocab = train.agg(F.countDistinct("x").alias("v"))
    ll = c.withColumn("z", F.sum("c").over(Window.partitionBy("y"))).crossJoin(F.broadcast(vocab))  # one row
    return prior, ll.select("y", "x", F.log((F.col("c") + alpha) / (F.col("z") + alpha * F.col("v"))).alias("ll"))


def classified(rows: DataFrame, prior: DataFrame, ll: DataFrame) -> DataFrame:
    """The label of largest log posterior of (inst, x) rows; features unseen with a label are skipped."""
    s = rows.join(ll, "x").groupBy("inst", "y").agg(F.sum("ll").alias("s")).join(F.broadcast(prior), "y")  # labels are few
    return s.groupBy("inst").agg(F.max_by("y", F.struct(F.round(F.col("s") + F.col("prior"), 9), "y")).alias("y"))


def set_hash(items: Column) -> Column:
    """The same number for the same set in any order."""
    return F.xxhash64(F.array_sort(F.array_distinct(items)))


def line_map(df: DataFrame, f: Callable[[str], str], column: str = "value") -> DataFrame:
    """A string function over all lines, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            pdf[column] = [None if v is None else f(v) for v in pdf[column]]
            yield pdf

    return df.mapInPandas(run, df.schema)


def piped(df: DataFrame, command: list[str], column: str = "value") -> DataFrame:
    """Lines through an external program, one run a batch; it must give one line for each."""

    def run(batches):
        for pdf in batches:
            got = subprocess.run(command, input="\n".join(pdf[column]) + "\n", capture_output=True, text=True, check=True).stdout.split("\n")[: len(pdf)]
            yield pd.DataFrame({column: got})

    return df.select(column).mapInPandas(run, f"{column} string")


def ecb_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc, token (from 0), sentence and text of ECB+ files."""
    df = spark.read.format("xml").option("rowTag", "Document").load(path)
    return df.select(F.col("_doc_name").alias("doc"), F.explode("token").alias("t")).select("doc", (F.col("t._t_id").cast("int") - 1).alias("token"), F.col("t._sentence").cast("int").alias("sentence"), F.col("t._VALUE").alias("text"))


def predicate_cover(paths: DataFrame) -> DataFrame:
    """Arguments with the predicate nearest to them, of (sent, arg, predicate, length) rows."""
    w = Window.partitionBy("sent", "arg").orderBy("length", "predicate")
    return paths.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def common_predicates(paths: DataFrame) -> DataFrame:
    """Predicates of both arguments, by log probability of their paths and closeness, per pair of arguments."""
    p = paths.groupBy("path").agg(F.count("*").alias("n"))
    x = paths.join(p.withColumn("lp", F.log(F.col("n") / F.sum("n").over(Window.partitionBy()))), "path")
    a, b = (x.select("sent", "predicate", F.col("arg").alias(k), F.col("lp").alias(f"lp_{k}"), F.col("length").alias(f"len_{k}")) for k in ("a", "b"))
    return a.join(b, ["sent", "predicate"]).where("a < b").withColumn("score", (F.col("lp_a") + F.col("lp_b")) * (F.col("len_a") + F.col("len_b")))


def gated(df: DataFrame, by: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows that come at least ``seconds`` after the last one let through, the first row of a group included.

    A group's rows are folded in order as one array.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(tie).alias("k"))))
    step = lambda acc, r: F.when(acc["last"].isNull() | (r["t"] - acc["last"] >= seconds), F.struct(r["t"].alias("last"), F.concat(acc["kept"], F.array(r["k"])).alias("kept"))).otherwise(acc)
    kind = df.schema[tie].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    return df.groupBy(*by).agg(F.aggregate(rows, start, step)["kept"].alias("kept")).select(*by, F.explode("kept").alias(tie))


def walk_features(edges: DataFrame, starts: DataFrame, hops: int, label: str = "rel") -> DataFrame:
    """(node, feature): labels along every walk of up to ``hops`` edges from a node of the fact graph, with the node it ends at.

    ``edges`` are (src, dst, label). A walk does not go back over the node it came from.
    """
    e = edges.select(F.col("src").alias("at"), "dst", F.col(label).alias("rel")).distinct()
    walk = starts.select("node", F.col("node").alias("at"), F.lit(None).cast(edges.schema["src"].dataType).alias("last"), F.lit("").alias("path"))
    out = None
    for _ in range(hops):
        walk = walk.join(e, "at").where(F.col("last").isNull() | (F.col("dst") != F.col("last")))
        walk = walk.select("node", F.col("dst").alias("to"), F.col("at").alias("last"), F.concat("path", F.lit("/"), "rel").alias("path")).withColumnRenamed("to", "at")
        own = walk.select("node", F.concat("path", F.lit("="), F.col("at").cast("string")).alias("feature")).distinct()
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def inverse_nominal(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words with the verbs a lexicon (noun, verb) gives for them, by lemma; those without one stay with none."""
    own = lexicon.groupBy(F.col("noun").alias("lemma")).agg(F.array_sort(F.collect_set("verb")).alias("verbs"))
    return words.join(own, "lemma", "left")
