"""Queries of counts, association, information, sketches and samples of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infogain as ig
from ..functions import scores, sketch, text
from ..operators import evaluate, retrieval
from .registry import query

JOINT = """j AS (SELECT l_returnflag AS y, p_brand AS x, count(*) AS n_yx FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
c AS (SELECT y, x, n_yx, sum(n_yx) OVER (PARTITION BY y) AS n_y, sum(n_yx) OVER (PARTITION BY x) AS n_x, sum(n_yx) OVER () AS n FROM j)"""


def flags(t):
    return t.lineitem.join(t.part, t.lineitem.l_partkey == t.part.p_partkey).select(F.col("l_returnflag").alias("y"), F.col("p_brand").alias("x"), "l_shipdate", "l_linestatus", "l_orderkey", "l_linenumber")


@query(f"WITH {JOINT} SELECT y, x, n_yx, round(ln(n_yx::DOUBLE * n / (n_y * n_x)), 8) AS pmi, round(ln(n_yx::DOUBLE * n / (n_y * n_x)) * n_yx / (n_yx + 5), 8) AS dpmi FROM c")
def pmi(t):
    return ig.pmi_table(flags(t), "y", "x", 5.0).select("y", "x", "n_yx", F.round("pmi", 8).alias("pmi"), F.round("dpmi", 8).alias("dpmi"))


@query(f"WITH {JOINT}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(ln(n_yx::DOUBLE * n / (n_y * n_x)), 8) DESC, x) AS rank FROM c) SELECT y, x, rank FROM r WHERE rank <= 5")
def pmi_top(t):
    table = ig.pmi_table(flags(t), "y", "x").withColumn("pmi", F.round("pmi", 8))
    return ig.top_pmi(table, 5).select("y", "x", F.col("rank").cast("long").alias("rank"))


@query("""WITH b AS (SELECT event_type AS y, json_extract_string(props, '$.k') AS x, sum((value > 50)::INT) AS n_yx, count(*) AS a FROM events GROUP BY 1, 2),
c AS (SELECT y, x, n_yx, sum(n_yx) OVER (PARTITION BY y) AS n_y, sum(a) OVER (PARTITION BY x) AS n_x, sum(a) OVER () AS n FROM b) SELECT y, x, n_yx::BIGINT AS n_yx, round(ln(n_yx::DOUBLE * n / (n_y * n_x)), 8) AS pmi FROM c WHERE n_yx > 0""")
def pmi_negatives(t):
    e = t.events.select("event_type", F.get_json_object("props", "$.k").alias("k"), (F.col("value") > 50).alias("pos"))
    return ig.pmi_with_negatives(e, "event_type", "k", "pos").select("y", "x", "n_yx", F.round("pmi", 8).alias("pmi"))


@query(f"WITH {JOINT} SELECT round(sum(n_yx / n::DOUBLE * ln(n_yx::DOUBLE * n / (n_y * n_x))), 8) AS ig FROM c")
def information_gain(t):
    return ig.information_gain(flags(t), "y", "x").select(F.round("ig", 8).alias("ig"))


@query("""WITH j AS (SELECT l_linestatus AS b, l_returnflag AS y, p_brand AS x, count(*) AS n_yx FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
c AS (SELECT b, n_yx, sum(n_yx) OVER (PARTITION BY b, y) AS n_y, sum(n_yx) OVER (PARTITION BY b, x) AS n_x, sum(n_yx) OVER (PARTITION BY b) AS n FROM j) SELECT b AS "by", round(sum(n_yx / n::DOUBLE * ln(n_yx::DOUBLE * n / (n_y * n_x))), 8) AS ig FROM c GROUP BY b""")
def information_gain_refined(t):
    return ig.refined_gain(flags(t), "y", "x", "l_linestatus").select("by", F.round("ig", 8).alias("ig"))


OBS = """o AS (SELECT l_orderkey * 10 + l_linenumber AS inst, 'brand' AS template, p_brand AS x FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'status', l_linestatus FROM lineitem),
l AS (SELECT l_orderkey * 10 + l_linenumber AS inst, l_returnflag AS y FROM lineitem)"""


def observations(t):
    f = flags(t).withColumn("inst", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    obs = f.select("inst", F.lit("brand").alias("template"), "x").unionByName(f.select("inst", F.lit("status").alias("template"), F.col("l_linestatus").alias("x")))
    return obs, f.select("inst", "y")


@query(f"""WITH {OBS}, p AS (SELECT template, y, x, count(*) AS n FROM o JOIN l USING (inst) GROUP BY 1, 2, 3), px AS (SELECT template, x, sum(n) AS n FROM p GROUP BY 1, 2),
hx AS (SELECT template, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM px GROUP BY 1), hyx AS (SELECT template, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM p GROUP BY 1),
hy AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT y, count(*) AS n FROM l GROUP BY 1))
SELECT hx.template, round(hx.h, 8) AS hx, round(hyx.h, 8) AS hyx, round(hy.h, 8) AS hy, round(hy.h + hx.h - hyx.h, 8) AS mi FROM hx JOIN hyx USING (template), hy""")
def template_information(t):
    out = ig.template_information(*observations(t))
    return out.select("template", *[F.round(c, 8).alias(c) for c in ("hx", "hyx", "hy", "mi")])


@query(f"""WITH {JOINT}, d AS (SELECT *, (n_y + 1.0) / (n + (SELECT count(DISTINCT y) FROM c)) AS py, (n_x + 1.0) / (n + (SELECT count(DISTINCT x) FROM c)) AS px FROM c),
e AS (SELECT (n_yx + 500 * py * px) / (n + 500) AS p, py * px AS m, n FROM d)
SELECT round(sum(p * ln(p / m)) + (1 - sum(m)) * 500 / (max(n) + 500) * ln(500 / (max(n) + 500)), 7) AS mi FROM e""")
def smoothed_information(t):
    return ig.smoothed_information(flags(t), "y", "x").select(F.round("mi", 7).alias("mi"))


@query()
def bub_entropy(t):
    c = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return ig.bub_entropy(c, "l_returnflag").withColumn("h", F.round("h", 6))


@query("SELECT l_returnflag AS template, round(avg(l_quantity), 6) AS hx, round(avg(l_tax), 6) AS hy, round(avg(l_discount), 6) AS hyx, round(avg(l_tax) + avg(l_quantity) - avg(l_discount), 6) AS mi FROM lineitem GROUP BY 1")
def averaged_shards(t):
    parts = t.lineitem.select(F.col("l_returnflag").alias("template"), F.col("l_quantity").alias("hx"), F.col("l_tax").alias("hy"), F.col("l_discount").alias("hyx"))
    return ig.averaged_shards(parts).select("template", *[F.round(c, 6).alias(c) for c in ("hx", "hy", "hyx", "mi")])


@query("""SELECT lang AS template, round(0.3 * max(n_chars) + 0.7 * sum(n_chars * length(source)) / sum(length(source)), 6) AS mi FROM documents GROUP BY lang""")
def max_mean_blend(t):
    d = t.documents.select(F.col("lang").alias("template"), F.col("n_chars").cast("double").alias("mi"), F.length("source").alias("weight"))
    return ig.between_max_and_mean(d, 0.3).select("template", F.round("mi", 6).alias("mi"))


@query("""SELECT lang AS template, round(avg((n_chars > 800)::INT), 8) AS selectivity, round(0.5 / (4 + 1.2 * 1.2) - 0.1 * greatest(0.0, -ln(avg((n_chars > 800)::INT))), 8) AS merit FROM documents GROUP BY lang""")
def feature_merit(t):
    d = t.documents.select(F.col("lang").alias("template"), F.when(F.col("n_chars") > 800, F.array(F.lit("x"))).otherwise(F.array()).alias("feats"))
    s = ig.selectivity(d, "feats")
    info = s.select("template", F.lit(0.5).alias("mi"), F.lit(1.2).alias("hx"))
    return ig.merits(info, s).select("template", F.round("selectivity", 8).alias("selectivity"), F.round("merit", 8).alias("merit"))


@query(f"WITH {OBS} SELECT template, x, count(*) AS n FROM o GROUP BY 1, 2")
def feature_counts(t):
    return ig.feature_counts(observations(t)[0])


@query(f"WITH {OBS} SELECT template, count(DISTINCT x) AS cardinality FROM o GROUP BY 1")
def template_cardinality(t):
    return ig.cardinality(observations(t)[0])


@query("""WITH w AS (SELECT lang AS template, unnest(string_split(lower(text), ' ')) AS x FROM documents), c AS (SELECT template, x, count(*) AS n FROM w GROUP BY 1, 2) SELECT template, round(sum((n = 1)::INT) / sum(n), 8) AS unseen FROM c GROUP BY 1""")
def unseen_rate(t):
    obs = t.documents.select(F.col("lang").alias("template"), F.explode(F.split(F.lower("text"), " ")).alias("x"))
    return ig.unseen_rate(obs).select("template", F.round("unseen", 8).alias("unseen"))


@query("SELECT event_type, round(var_pop(value), 6) AS variance FROM events GROUP BY 1")
def feature_variance(t):
    return ig.total_variance(t.events, "event_type", ["value"]).select("event_type", F.round("variance", 6).alias("variance"))


A = (2654435761, 2246822519, 3266489917, 668265263)
BUCKET = "CASE r WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END".format(*[str(m % 2147483647 % 65521) for m in A])
CELLS = f"SELECT k, n, r, ((k % 2147483647) * ({BUCKET}) + r * 7919) % 2147483647 % 256 AS b FROM f, range(0, 4) AS t(r)"


@query(f"""WITH f AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS ({CELLS}), s AS (SELECT r, b, max(n) AS v FROM c GROUP BY 1, 2) SELECT k, min(v) AS estimate FROM c JOIN s USING (r, b) GROUP BY k""")
def max_min_sketch(t):
    f = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    s = sketch.max_min_sketch(f, "k", "n", 4, 256, sketch.arithmetic_bucket)
    return sketch.estimates(f, "k", s, 4, 256, sketch.arithmetic_bucket)


@query(f"""WITH f AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS ({CELLS}), s AS (SELECT r, b, sum(n) AS v FROM c GROUP BY 1, 2) SELECT k, min(v)::BIGINT AS estimate FROM c JOIN s USING (r, b) GROUP BY k""")
def count_min_sketch(t):
    k = t.lineitem.select(F.col("l_partkey").alias("k"))
    s = sketch.count_min_sketch(k, "k", 4, 256, bucket=sketch.arithmetic_bucket)
    return sketch.estimates(k, "k", s, 4, 256, sketch.arithmetic_bucket)


@query()
def count_min_builtin(t):
    return t.lineitem.agg(F.length(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(1))).alias("bytes"))


@query()
def count_min_conservative(t):
    return sketch.conservative_sketch(t.lineitem, "l_partkey", "l_orderkey").groupBy("part", "row").agg(F.sum("value").alias("total"))


@query("""WITH f AS (SELECT l_partkey AS k, count(*) AS tok, count(DISTINCT l_orderkey) AS doc FROM lineitem GROUP BY 1) SELECT k, tok, doc FROM f ORDER BY round(tok + doc + 2.0 * tok * doc / (tok + doc), 6) DESC, k LIMIT 50""")
def heavy_hitters(t):
    f = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("tok"), F.countDistinct("l_orderkey").alias("doc"))
    return sketch.heavy_hitters(f, "k", "tok", "doc", 50)[0].select("k", "tok", "doc")


@query("SELECT p_type AS s, p_brand AS v, p_size::VARCHAR AS o, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type, p_brand, p_size::VARCHAR), (p_type, p_brand), (p_brand, p_size::VARCHAR))")
def argument_type_counts(t):
    return retrieval.argument_type_counts(t.part.select(F.col("p_type").alias("s"), F.col("p_brand").alias("v"), F.col("p_size").cast("string").alias("o")))


@query("""SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY n), 4) AS median, max(n) AS most, sum(n)::BIGINT AS total FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def facts_per_entity(t):
    c = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return c.agg(F.round(F.percentile("n", 0.5), 4).alias("median"), F.max("n").alias("most"), F.sum("n").alias("total"))


@query("SELECT lang, list_sort(list(DISTINCT source)) AS values FROM documents GROUP BY lang")
def multimap(t):
    from ..operators.facts import multimap as mm

    return mm(t.documents, "lang", "source", distinct=True)


@query("""WITH f AS (SELECT lang, source, count(*) AS df FROM documents GROUP BY 1, 2), m AS (SELECT lang, source, df, sum(df) OVER (PARTITION BY source) AS d, sum(df) OVER (PARTITION BY lang) AS n_l, sum(df) OVER () AS n FROM f)
SELECT lang, source, round(0.7 * ln(n_l / (df + 1)) + 0.3 * ln(n / (d + 1)), 8) AS idf FROM m""")
def backoff_idf(t):
    from pyspark.sql import Window

    f = t.documents.groupBy("lang", "source").agg(F.count("*").alias("df"))
    over = lambda *c: F.sum("df").over(Window.partitionBy(*c))
    return f.select("lang", "source", F.round(scores.backoff_idf(over(), F.col("df") * 0 + over("source"), over("lang"), F.col("df"), 0.3), 8).alias("idf"))


@query("""SELECT event_id, round((value + 1 - 1 + 2) / (100 + 3 + 4 - 2), 8) AS beta, round(1 / (1 + exp(2 - value / 2)), 8) AS link, round(1001 / (1000 + value), 8) AS prior, round(CASE WHEN value >= 100 THEN 0 ELSE ln((1 + value) / 101) END, 8) AS logp, round(3 / (2 + value), 8) AS path, round(CASE WHEN value + 3 = 0 THEN 0 ELSE 6 * value / (value + 3) END, 8) AS f1 FROM (SELECT event_id, abs(value) AS value FROM events)""")
def score_functions(t):
    v = F.abs("value")
    r = lambda c, n: F.round(c, 8).alias(n)
    return t.events.select("event_id", r(scores.beta_map(v, F.lit(100.0), 3, 4), "beta"), r(scores.link_probability(v), "link"), r(scores.frequency_prior(v), "prior"), r(scores.feature_log_prob(v, F.lit(100.0)), "logp"), r(scores.path_score(v), "path"), r(scores.harmonic(v, F.lit(3.0)), "f1"))


@query("""WITH f AS (SELECT l_partkey AS k, count(*) AS tok, count(DISTINCT l_suppkey) AS doc FROM lineitem GROUP BY 1), g AS (SELECT k, 2.0 * greatest(tok, 3) * greatest(doc, 3) / (greatest(tok, 3) + greatest(doc, 3)) AS f FROM f) SELECT k, round(ln(1000) - ln(f), 8) AS idf, round(11 / (10 + f), 8) AS prior FROM g""")
def triage_scores(t):
    f = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("tok"), F.countDistinct("l_suppkey").alias("doc"))
    s = lambda m: F.round(scores.triage_score(F.col("tok"), F.col("doc"), F.lit(1000), m), 8).alias(m)
    return f.select("k", s("idf"), s("prior"))


@query("SELECT round(1.25 * max(n), 4)::DOUBLE AS estimate FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def doc_count_estimate(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).agg(F.round(scores.doc_count_estimate(F.col("n")), 4).cast("double").alias("estimate"))


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda x, y: 0.9 * x + 0.1 * y), 6) AS ema FROM a""")
def moving_average(t):
    from ..operators.decide import moving_average as ema

    v = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    return t.events.groupBy("user_id").agg(v.alias("v")).select("user_id", F.round(ema(F.col("v"), 0.9), 6).alias("ema"))


@query("""SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS days FROM events""")
def days_between(t):
    return t.events.select("event_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"))


@query("""SELECT user_id, round(s[least(3, len(s))], 6) AS score FROM (SELECT user_id, list(value ORDER BY value DESC) AS s FROM events GROUP BY 1)""")
def rank_th_score(t):
    return t.events.groupBy("user_id").agg(F.collect_list("value").alias("s")).select("user_id", F.round(scores.rank_th(F.col("s"), 2), 6).alias("score"))


@query("""WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, q, list_sum(list_transform(q, lambda x: exp(x / 10 - list_max(q) / 10))) AS z FROM g) SELECT l_orderkey, round(list_sum(list_transform(q, lambda x: exp(x / 10 - list_max(q) / 10) / z)), 6) AS mass, round(q[1] / 10 - list_max(q) / 10 - ln(z), 6) AS first FROM s""")
def log_probabilities(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("q"))
    p = scores.softened(F.col("q"), 10.0)
    return g.select("l_orderkey", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + F.exp(x)), 6).alias("mass"), F.round(p[0], 6).alias("first"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def answer_tallies(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages")
def log_extraction(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n"))
