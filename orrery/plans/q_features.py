"""Queries of the feature-template language, alphabets and frequency transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infogain as ig
from ..functions import templates as tp
from .registry import query

TOKENS = "array<struct<word:string,lemma:string,pos:string,deprel:string,head:int>>"


def spans(x):
    """Conversations of tokens with a target of their first two tokens and their last token as argument."""
    return x.select("conv_id", "tokens", F.struct(F.lit(0).alias("start"), F.least(F.lit(2), F.size("tokens")).alias("end")).alias("target"), F.struct((F.size("tokens") - 1).alias("start"), F.size("tokens").alias("end")).alias("arg"), F.lit("f").alias("frame"), F.lit("r").alias("role"))


def chained(words):
    """Tokens of an ordered array of (word, role), each depending on the one before."""
    return F.transform(words, lambda s, i: F.struct(s["word"].alias("word"), F.lower(s["word"]).alias("lemma"), s["role"].alias("pos"), F.concat(F.lit("d"), s["role"]).alias("deprel"), (i - 1).cast("int").alias("head"))).cast(TOKENS)


def sentences(t):
    """Conversations as sentences of all words of all turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    words = F.flatten(F.transform(turns, lambda s: F.transform(F.split(s["text"], " "), lambda w: F.struct(w.alias("word"), s["role"].alias("role")))))
    return spans(t.conversations.groupBy("conv_id").agg(chained(words).alias("tokens")))


def extracted(x, spec="Span1-First-Pos*Span2-Last-Pos + Span1-Head-Word + Span1-Span2-Relation"):
    return tp.extracted(x, ["conv_id"], tp.compiled(spec, tp.basic_templates()))


@query("""WITH o AS (SELECT conv_id, list(role ORDER BY turn) AS r, sum(len(string_split(text, ' '))) AS n FROM conversations GROUP BY 1) SELECT conv_id, 'Span1-First-Pos*Span2-Last-Pos' AS template, r[1] || '_' || r[-1] AS x FROM o
UNION ALL SELECT conv_id, 'Span1-Span2-Relation', CASE WHEN least(2, n) <= n - 1 THEN 'before' WHEN n = 1 THEN 'same' ELSE 'covers' END FROM o""")
def feature_products(t):
    return extracted(sentences(t), "Span1-First-Pos*Span2-Last-Pos + Span1-Span2-Relation")


@query("""WITH o AS (SELECT conv_id, list(split_part(text, ' ', 1) ORDER BY turn) AS w FROM conversations GROUP BY 1), x AS (SELECT w[1] AS x, count(*) AS n FROM o GROUP BY 1) SELECT x, n FROM (SELECT x, n, row_number() OVER (ORDER BY n DESC, x) AS r FROM x) WHERE r <= 10""")
def feature_top_k(t):
    obs = extracted(sentences(t), "Span1-Head-Word")
    return tp.top_k(ig.feature_counts(obs), 10).select("x", "n")


@query("""WITH o AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1), x AS (SELECT r[1] AS x, count(*) AS n FROM o GROUP BY 1) SELECT x, n FROM x WHERE n >= 8""")
def feature_cnt_k(t):
    return tp.at_least(ig.feature_counts(extracted(sentences(t), "Span1-First-Pos")), 8).select("x", "n")


@query("""SELECT l_returnflag || '_' || l_linestatus AS x, count(*) AS n FROM lineitem GROUP BY 1""")
def template_product(t):
    x = t.lineitem.select(F.explode(tp.product(tp.one(F.col("l_returnflag")), tp.one(F.col("l_linestatus")))).alias("x"))
    return x.groupBy("x").agg(F.count("*").alias("n"))


A = "a AS (SELECT p_brand AS st, p_type AS sf FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), b AS (SELECT p_brand AS st, p_type AS sf FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1, 2)"


def alphabets(t):
    x = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("template"), F.col("p_type").alias("x"))
    side = lambda r: tp.alphabet(x.where(F.col("k") % 3 != r)).select(F.col("template").alias("strT"), F.col("x").alias("strF"), F.col("t").alias("newT"), F.col("f").alias("newF"))
    return side(0), side(1)


@query("""WITH p AS (SELECT DISTINCT p_brand AS template, p_type AS x FROM part) SELECT template, x, dense_rank() OVER (ORDER BY template) - 1 AS t, row_number() OVER (PARTITION BY template ORDER BY x) - 1 AS f FROM p""")
def alphabet_build(t):
    a = tp.alphabet(t.part.select(F.col("p_brand").alias("template"), F.col("p_type").alias("x")))
    return a.select("template", "x", F.col("t").cast("long").alias("t"), F.col("f").cast("long").alias("f"))


@query(f"""WITH {A}, m AS (SELECT coalesce(a.st, b.st) AS st, coalesce(a.sf, b.sf) AS sf, a.sf IS NULL AS only_b, b.sf IS NULL AS only_a FROM a FULL JOIN b ON a.st = b.st AND a.sf = b.sf)
SELECT st AS "strT", sf AS "strF", only_a, only_b, row_number() OVER (PARTITION BY st ORDER BY sf) - 1 AS "newF" FROM m""")
def alphabet_merge(t):
    m = tp.merged_alphabets(*alphabets(t))
    return m.select("strT", "strF", (F.col("oldF_b") < 0).alias("only_a"), (F.col("oldF_a") < 0).alias("only_b"), F.col("newF").cast("long").alias("newF"))


@query(f"""WITH {A} SELECT a.st AS "strT", a.sf AS "strF" FROM a JOIN b ON a.st = b.st AND a.sf = b.sf""")
def alphabet_intersection(t):
    return tp.common_alphabet(*alphabets(t)).select("strT", "strF")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY 1""")
def feature_projection(t):
    """Parts of small size have new numbers; the features of others are dropped."""
    feats = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("t"), F.col("l_partkey").cast("int").alias("f"))))
    x = t.lineitem.groupBy("l_orderkey").agg(feats.alias("feats"))
    parts = t.part.where("p_size <= 25").select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("oldT"), F.col("p_partkey").cast("int").alias("oldF"))
    b = parts.select("oldT", "oldF", F.col("oldT").alias("newT"), (F.col("oldF") * 2).alias("newF"))
    return tp.projected(x, b, ["l_orderkey"]).select("l_orderkey", F.size("feats").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber * 7 + l_quantity::BIGINT % 7) * 11 + l_suppkey % 11 AS i, true AS back FROM lineitem")
def product_flattening(t):
    v, cards = [F.col("l_linenumber"), F.col("l_quantity").cast("long") % 7, F.col("l_suppkey") % 11], [8, 7, 11]
    x = t.lineitem.withColumn("i", tp.flat_index(v, cards))
    back = tp.unflat_index(F.col("i"), cards)
    return x.select("l_orderkey", "l_linenumber", "i", ((back[0] == v[0]) & (back[1] == v[1]) & (back[2] == v[2])).alias("back"))
