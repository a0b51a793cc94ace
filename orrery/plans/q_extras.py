"""Queries of paths, naive Bayes and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infogain as ig
from ..functions import paths
from ..operators import extras
from .q_features import sentences
from .q_stats import OBS, observations
from .registry import query


def paths_of(s):
    last = F.size("tokens") - 1
    text = paths.path_text(F.col("tokens"), last, F.lit(0), most=1 << 30)
    return s.select("conv_id", F.array_max(paths.depths(F.col("tokens"))).alias("depth"), F.nullif(text, F.lit("")).alias("path"))


def spans_of(s):
    return s.select("conv_id", paths.subtree(F.col("tokens"), F.lit(0)).alias("s")).select("conv_id", "s.start", "s.end")


@query("""WITH t AS (SELECT conv_id, turn, role, len(string_split(text, ' ')) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
SELECT conv_id, (sum(n) - 1)::INT AS depth, nullif(string_agg(repeat('d' || role || '<', (n - (turn = first)::INT)::INT), '' ORDER BY turn DESC), '') AS path FROM t GROUP BY conv_id""")
def dependency_paths(t):
    return paths_of(sentences(t))


@query("SELECT conv_id, 0 AS start, sum(len(string_split(text, ' ')))::INT AS \"end\" FROM conversations GROUP BY conv_id")
def dependency_spans(t):
    return spans_of(sentences(t))


@query("""WITH c AS (SELECT l_returnflag AS y, p_brand AS x, count(*) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT y, x, round(ln((c + 1.0) / (sum(c) OVER (PARTITION BY y) + (SELECT count(DISTINCT x) FROM c))), 8) AS ll FROM c""")
def naive_bayes(t):
    f = t.lineitem.join(t.part, t.lineitem.l_partkey == t.part.p_partkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inst"), F.col("l_returnflag").alias("y"), F.col("p_brand").alias("x"))
    return extras.naive_bayes(f)[1].select("y", "x", F.round("ll", 8).alias("ll"))


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT a.k, least(a.n, b.n) AS n FROM a JOIN b USING (k)""")
def merge_intersection(t):
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return extras.merge_intersection(side("R"), side("A"), "k").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def hash_intersection(t):
    return extras.intersection(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def sentence_instance_merge(t):
    out = extras.merged_by_sentence(t.orders.select(F.col("o_orderkey").alias("sent")), t.lineitem.select(F.col("l_orderkey").alias("sent"), "l_partkey"))
    return out.select(F.col("sent").alias("o_orderkey"), F.coalesce(F.size("instances"), F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {OBS}, p AS (SELECT a.inst, a.x || '_' || b.x AS x FROM o a JOIN o b ON a.inst = b.inst AND a.template = 'brand' AND b.template = 'status'), c AS (SELECT y, x, count(*) AS n FROM p JOIN l USING (inst) GROUP BY 1, 2), px AS (SELECT x, sum(n) AS n FROM c GROUP BY 1),
hy AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT y, count(*) AS n FROM l GROUP BY 1))
SELECT 'brand*status' AS template, round((SELECT h FROM hy) + (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM px) - (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM c), 7) AS mi""")
def product_information(t):
    pairs = t.spark.createDataFrame([("brand", "status")], "a string, b string")
    return extras.product_information(*observations(t), pairs).select("template", F.round("mi", 7).alias("mi"))


@query("SELECT doc_id, upper(lang) AS lang FROM documents")
def line_map(t):
    return extras.line_map(t.documents.select("doc_id", "lang"), str.upper, "lang")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def set_hashes(t):
    """Sets in two orders hash alike."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"))
    same = extras.set_hash(F.col("s")) == extras.set_hash(F.reverse("s"))
    return g.where(same).select("l_orderkey", F.size(F.array_distinct("s")).cast("long").alias("n"))


@query("SELECT l_returnflag AS y, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def label_features(t):
    f = t.lineitem.join(t.part, t.lineitem.l_partkey == t.part.p_partkey).select(F.col("l_returnflag").alias("y"), F.col("p_brand").alias("x"))
    return ig.joint_counts(f, "y", "x").groupBy("y").agg(F.count("*").alias("n"))
