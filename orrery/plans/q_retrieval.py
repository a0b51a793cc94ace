"""Queries of the inverted index, similarity, linking, distant supervision, clustering and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, vectors
from ..operators import retrieval, sample, summarize
from .lineage import cut
from .q_text import WORDS
from .registry import query, spread

COUNTS = f"w AS (SELECT doc_id AS doc, unnest({WORDS}) AS term FROM documents), c AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT doc) AS n FROM c)"


def counts(t):
    """Words of documents, counted once and kept, as idf, weights and norms all start from them."""
    return cut(term_rows(t))


def term_rows(t):
    return vectors.term_counts(spread(t.documents.select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("w")), "doc_id", "w")


def documents_in(c):
    """One row: the number of documents that have a term."""
    return c.select("doc").distinct().agg(F.count("*").alias("n"))


def idf(t, c, compat=True):
    n = documents_in(c)
    return vectors.document_frequency(c).crossJoin(F.broadcast(n)).select("term", "df", scores.idf(F.col("n"), F.col("df"), compat).alias("idf"))  # one row


@query(f"WITH {COUNTS} SELECT doc, term, tf FROM c")
def term_counts(t):
    return term_rows(t)


@query(f"WITH {COUNTS} SELECT term, df, round(ln(n // df), 8) AS idf, round(ln(n / df), 8) AS exact, round(ln(n) - ln(df + 1), 8) AS raw, round(ln((n + 1) / (df + 1)), 8) AS cluster FROM d, n")
def inverse_df(t):
    c = term_rows(t)
    n = documents_in(c)
    d = vectors.document_frequency(c).crossJoin(F.broadcast(n))  # one row
    r = lambda x, k: F.round(x, 8).alias(k)
    return d.select("term", "df", r(scores.idf(F.col("n"), F.col("df")), "idf"), r(scores.idf(F.col("n"), F.col("df"), False), "exact"), r(scores.raw_idf(F.col("n"), F.col("df")), "raw"), r(scores.cluster_idf(F.col("n"), F.col("df")), "cluster"))


@query(f"""WITH {COUNTS}, s AS (SELECT doc, term, tf * ln(n // df) AS s FROM c JOIN d USING (term), n), r AS (SELECT doc, term, s, row_number() OVER (PARTITION BY doc ORDER BY round(s, 6) DESC, term) AS rank FROM s WHERE s >= 1e-4) SELECT doc, term, round(s, 6) AS score, rank FROM r WHERE rank <= 10""")
def important_terms(t):
    c = counts(t)
    i = idf(t, c).withColumn("idf", F.col("idf"))
    w = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 6)), "term")
    scored = c.join(i, "term").withColumn("score", F.col("tf") * F.col("idf")).where("score >= 1e-4")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("doc", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


PAIRS = "p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def neighbours(t):
    """Every document and the next one."""
    return t.documents.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(t.documents.select(F.col("doc_id").alias("b")), "b", "left_semi")


def cosine_query(kind: str, sql: str):
    @query(f"""WITH {COUNTS}, {PAIRS}, v AS (SELECT doc, term, {sql} AS w FROM c JOIN d USING (term), n), z AS (SELECT doc, sqrt(sum(w * w)) AS z FROM v GROUP BY 1),
o AS (SELECT a, b, sum(x.w * y.w) AS dot FROM p JOIN v x ON x.doc = a JOIN v y ON y.doc = b AND y.term = x.term GROUP BY 1, 2)
SELECT p.a, p.b, round(CASE WHEN za.z * zb.z > 0 THEN coalesce(dot, 0) / (za.z * zb.z) ELSE 0 END, 8) AS cosine FROM p LEFT JOIN o ON o.a = p.a AND o.b = p.b LEFT JOIN z za ON za.doc = p.a LEFT JOIN z zb ON zb.doc = p.b""", name=f"cosine_{kind}")
    def run(t):
        c = counts(t)
        w = c.join(idf(t, c), "term").select("doc", "term", vectors.weight(kind, F.col("tf"), F.col("idf"), 0.5).alias("w"))
        return vectors.cosine_pairs(w, neighbours(t)).select("a", "b", F.round("cosine", 8).alias("cosine"))


cosine_query("plain", "tf * sqrt(ln(n // df))")
cosine_query("exp", "tf * exp(0.5 * sqrt(ln(n // df)))")
cosine_query("hashed", "tf * ln(n // df)")


@query(f"""WITH {COUNTS}, {PAIRS}, s AS (SELECT a, b, 'a' AS side, term, tf, ln(n // df) AS idf FROM p JOIN c ON doc = a JOIN d USING (term), n UNION ALL SELECT a, b, 'b', term, tf, ln(n // df) FROM p JOIN c ON doc = b JOIN d USING (term), n),
v AS (SELECT a, b, side, term, tf * sqrt(exp(idf / max(idf) OVER (PARTITION BY a, b))) AS w FROM s), m AS (SELECT a, b, term, sum(CASE WHEN side = 'a' THEN w ELSE 0 END) AS x, sum(CASE WHEN side = 'b' THEN w ELSE 0 END) AS y FROM v GROUP BY 1, 2, 3)
SELECT a, b, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 8) AS cosine FROM m GROUP BY 1, 2""")
def cosine_max_exp(t):
    c = counts(t)
    return vectors.pair_cosine(vectors.max_exp_weights(c, neighbours(t), idf(t, c).select("term", "idf"))).select("a", "b", F.round("cosine", 8).alias("cosine"))


@query(f"""WITH {COUNTS}, s AS (SELECT doc, term, tf, row_number() OVER (PARTITION BY doc ORDER BY tf * round(ln(n // df), 9) DESC, term) AS r FROM c JOIN d USING (term), n) SELECT doc, count(*) AS n, sum(least(tf, 127))::BIGINT AS total FROM s WHERE r <= 128 GROUP BY 1""")
def truncated_vectors(t):
    c = counts(t)
    i = idf(t, c).select("term", F.round("idf", 9).alias("idf"))
    return vectors.truncated(c, i).groupBy("doc").agg(F.count("*").alias("n"), F.sum("tf").alias("total"))


def index(t):
    """Mentions are order lines: the token is the line, the document its order, features are part and supplier."""
    m = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tok"), F.col("l_orderkey").alias("comm"), F.array(F.concat(F.lit("h:"), F.col("l_partkey") % 100), F.concat(F.lit("pi:"), F.col("l_suppkey") % 10), F.concat(F.lit("pb:"), "l_returnflag")).alias("feats"))
    return m


F2T = "m AS (SELECT l_orderkey || '-' || l_linenumber AS tok, l_orderkey AS comm, unnest(['h:' || l_partkey % 100, 'pi:' || l_suppkey % 10, 'pb:' || l_returnflag]) AS feat FROM lineitem), f2t AS (SELECT feat, tok, least(count(*), 127) AS cnt FROM m GROUP BY 1, 2), q AS (SELECT 'h:7' AS feat, 3.0 AS s UNION ALL SELECT 'pi:3', 2.0 UNION ALL SELECT 'pb:R', 0.5)"


def query_feats(t):
    return t.spark.createDataFrame([("h:7", 3.0), ("pi:3", 2.0), ("pb:R", 0.5)], "feat string, s double")


def tables(t):
    w = t.lineitem.select(F.col("l_orderkey").alias("comm"), F.col("l_shipdate").cast("string").alias("word"), F.lit(1).alias("cnt"))
    return retrieval.build_index(index(t), w, w.groupBy("word").agg((1.0 / F.count("*")).alias("idf")))


@query(f"WITH {F2T} SELECT feat, count(*) AS n, sum(cnt)::BIGINT AS total FROM f2t GROUP BY 1")
def index_postings(t):
    return tables(t)["f2t"].groupBy("feat").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS comms FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def index_token_documents(t):
    return tables(t)["t2c"].agg(F.count("*").alias("n"), F.countDistinct("comm").alias("comms"))


@query("SELECT comm, count(*) AS n FROM (SELECT l_orderkey AS comm, l_shipdate FROM lineitem) GROUP BY 1")
def index_document_words(t):
    return tables(t)["c2w"].groupBy("comm").agg(F.count("*").alias("n"))


@query(f"WITH {F2T} SELECT feat, count(*) AS tok_freq, count(DISTINCT split_part(tok, '-', 1)) AS doc_freq FROM f2t GROUP BY 1")
def feature_frequencies(t):
    return retrieval.feature_frequencies(tables(t)["f2t"], F.substring_index("tok", "-", 1))


@query(f"WITH {F2T} SELECT tok, round((sum(s) * sum(s) - sum(s * s)) / 2, 6)::DOUBLE AS score FROM f2t JOIN q USING (feat) GROUP BY 1 HAVING count(*) > 1")
def intersective_query(t):
    return retrieval.intersective(tables(t)["f2t"], query_feats(t)).select("tok", F.round("score", 6).alias("score"))


TRIAGE = f"""WITH {F2T}, f AS (SELECT feat, 2.0 * greatest(count(*), 3) * greatest(count(DISTINCT split_part(tok, '-', 1)), 3) / (greatest(count(*), 3) + greatest(count(DISTINCT split_part(tok, '-', 1)), 3)) AS f FROM f2t GROUP BY 1),
e AS (SELECT tok, sum(ln(100000) - ln(f)) AS m FROM f2t JOIN q USING (feat) JOIN f USING (feat) GROUP BY 1)"""


@query(f"{TRIAGE} SELECT tok, round(m, 6) AS ent_match FROM e")
def triage(t):
    f2t = tables(t)["f2t"]
    fr = retrieval.feature_frequencies(f2t, F.substring_index("tok", "-", 1), query_feats(t))
    return retrieval.triage(f2t, query_feats(t), fr, 100000).select("tok", F.round("ent_match", 6).alias("ent_match"))


@query(f"{TRIAGE}, x AS (SELECT tok, split_part(tok, '-', 1)::BIGINT AS comm, m, (split_part(tok, '-', 1)::BIGINT % 10) / 10.0 AS s FROM e) SELECT tok, comm, round(s + m + 10 * m * (0.1 + s), 5) AS score FROM x WHERE s + m + 10 * m * (0.1 + s) >= 1e-4 AND NOT (s < 0.05 AND m < 0.001)")
def triage_search(t):
    ix = tables(t)
    fr = retrieval.feature_frequencies(ix["f2t"], F.substring_index("tok", "-", 1), query_feats(t))
    sim = t.orders.select(F.col("o_orderkey").alias("comm"), (F.col("o_orderkey") % 10 / 10).alias("tfidf"))
    return retrieval.search(retrieval.triage(ix["f2t"], query_feats(t), fr, 100000), ix["t2c"], sim).select("tok", "comm", F.round("score", 5).alias("score"))


@query("""WITH a AS (SELECT l_orderkey AS c, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS c, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT a.c AS comm, a.q + b.q AS score FROM a JOIN b ON a.c = b.c""")
def two_entity_search(t):
    side = lambda k: t.lineitem.where(F.col("l_returnflag") == k).select(F.col("l_orderkey").alias("comm"), F.col("l_quantity").alias("tfidf"))
    return retrieval.two_entities(side("R"), side("A")).select("comm", "score")


@query("""WITH p AS (SELECT DISTINCT l_returnflag AS ner, l_partkey % 100 AS feat, l_orderkey AS tok FROM lineitem), d AS (SELECT ner, feat, count(*) AS df FROM p GROUP BY 1, 2) SELECT tok, round(sum(power(1000.0 / df, 0.25) / 2), 6) AS score FROM p JOIN d USING (ner, feat) WHERE (ner, feat) IN (('R', 5), ('A', 9)) GROUP BY 1""")
def ner_search(t):
    p = t.lineitem.select(F.col("l_returnflag").alias("ner"), (F.col("l_partkey") % 100).alias("feat"), F.col("l_orderkey").alias("tok")).distinct()
    q = t.spark.createDataFrame([("R", 5), ("A", 9)], "ner string, feat long")
    return retrieval.ner_search(p, q, 1000).select("tok", F.round("score", 6).alias("score"))


@query(f"WITH {F2T}, f AS (SELECT feat, count(DISTINCT split_part(tok, '-', 1)) AS df FROM f2t JOIN q USING (feat) GROUP BY 1), i AS (SELECT feat, ln(100000.0 / df) AS idf FROM f), b AS (SELECT feat, idf, coalesce(sum(idf) OVER (ORDER BY idf DESC, feat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(idf) OVER () AS b FROM i) SELECT feat, round(idf, 6) AS idf FROM b WHERE b < 0.75")
def fast_triage(t):
    fr = retrieval.feature_frequencies(tables(t)["f2t"], F.substring_index("tok", "-", 1), query_feats(t))
    return retrieval.covering_features(fr, query_feats(t), 100000).select("feat", F.round("idf", 6).alias("idf"))


@query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS c, list(DISTINCT l_linestatus) AS t FROM lineitem GROUP BY 1), j AS (SELECT k, c, t, len(list_intersect(['R', 'A'], c)) / (1 + len(list_distinct(list_concat(['R', 'A'], c)))) AS cc, len(list_intersect(['R', 'A'], t)) / (1 + len(list_distinct(list_concat(['R', 'A'], t)))) AS ct,
len(list_intersect(['O'], c)) / (1 + len(list_distinct(list_concat(['O'], c)))) AS tc, len(list_intersect(['O'], t)) / (1 + len(list_distinct(list_concat(['O'], t)))) AS tt FROM a) SELECT k, round(cc + 2 * ct + 2 * tc + 8 * tt, 8) AS score FROM j""")
def attribute_rerank(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("comm_attrs"), F.collect_set("l_linestatus").alias("tok_attrs"))
    return retrieval.attribute_rerank(a, F.array(F.lit("R"), F.lit("A")), F.array(F.lit("O"))).select("k", F.round("score", 8).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, first_value(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_linenumber) AS canonical FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)""")
def one_per_lemma(t):
    x = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    return retrieval.one_per_lemma(x, "l_orderkey", "l_returnflag", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "canonical")


@query()
def near_duplicate_filter(t):
    c = term_rows(t)
    vec = c.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("tf").cast("double")))).alias("vec"))
    d = t.documents.select("source", F.col("doc_id").alias("rank"), F.col("doc_id").alias("key"), F.col("doc_id").alias("doc")).join(vec, "doc", "left")
    return retrieval.near_duplicates(d, "source", 0.9)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def object_dedup(t):
    return sample.unique_by(t.documents, ["text"], ["doc_id"]).select("doc_id")


@query("""WITH f AS (SELECT 's' || p_partkey AS subj, p_brand AS verb, 's' || (p_partkey + 1) AS obj FROM part)
SELECT DISTINCT sent, subj, verb, obj FROM (SELECT DISTINCT l_orderkey AS sent, 's' || l_suppkey AS ent FROM lineitem) JOIN f ON ent = subj OR ent = obj""")
def distant_supervision(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("sent"), F.col("l_suppkey").alias("mid"))
    mids = t.supplier.select(F.col("s_suppkey").alias("mid"), F.concat(F.lit("s"), "s_suppkey").alias("dbp"))
    f = t.part.select(F.concat(F.lit("s"), "p_partkey").alias("subj"), F.col("p_brand").alias("verb"), F.concat(F.lit("s"), F.col("p_partkey") + 1).alias("obj"))
    return retrieval.distant_supervision(links, mids, f)


@query("""SELECT s_nationkey AS dir, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct([p_size % 25, (p_size + 1) % 25])) AS k FROM part) JOIN supplier ON s_nationkey = k GROUP BY 1""")
def entity_lines(t):
    f = t.part.select(F.col("p_partkey").alias("line"), (F.col("p_size") % 25).alias("subj"), ((F.col("p_size") + 1) % 25).alias("obj"))
    mids = t.nation.select(F.col("n_nationkey").alias("dbp"), F.col("n_nationkey").alias("mid"))
    dirs = t.supplier.select(F.col("s_nationkey").alias("mid"), F.col("s_nationkey").alias("dir"))
    return retrieval.entity_lines(f, mids, dirs).groupBy("dir").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS sent, l_suppkey AS ent FROM lineitem) SELECT a.ent AS a, b.ent AS b, count(*) AS n FROM m a JOIN m b ON a.sent = b.sent AND a.ent <> b.ent GROUP BY 1, 2""")
def related_entities(t):
    return retrieval.related_entities(t.lineitem.select(F.col("l_orderkey").alias("sent"), F.col("l_suppkey").alias("ent")))


@query("""WITH x AS (SELECT c_custkey AS m, s_suppkey AS e, 1.0 - abs(c_acctbal - s_acctbal) / 10000 AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey), r AS (SELECT m, e, s, row_number() OVER (PARTITION BY m ORDER BY s DESC, e) AS n FROM x WHERE s > 0.9) SELECT c_custkey AS mention, e AS entity, round(coalesce(s, 0.9), 6)::DOUBLE AS score FROM customer LEFT JOIN r ON m = c_custkey AND n = 1""")
def entity_linking(t):
    m = t.customer.select(F.col("c_custkey").alias("mention"), F.col("c_nationkey").alias("k"), "c_acctbal")
    e = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("k"), "s_acctbal")
    return retrieval.link_entities(m, e, "k", 1.0 - F.abs(F.col("c_acctbal") - F.col("s_acctbal")) / 10000, 0.9).select("mention", "entity", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT l_orderkey AS a, l_partkey AS e, l_returnflag AS f, sum(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3), b AS (SELECT l_orderkey AS b, l_partkey AS e, l_returnflag AS f, sum(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3)
SELECT a, b, round(sum(sqrt(a.w * b.w)), 4) AS score FROM a JOIN b USING (e, f) GROUP BY 1, 2""")
def situation_linking(t):
    side = lambda n: t.lineitem.where(F.col("l_linestatus") == n).groupBy(F.col("l_orderkey").alias("situation"), F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("feat")).agg(F.sum("l_quantity").alias("w"))
    return retrieval.link_situations(side("O"), side("F")).select("a", "b", F.round("score", 4).alias("score"))


@query(f"""WITH j AS (SELECT l_returnflag AS y, CASE WHEN p_size % 2 = 0 THEN 'm:' ELSE 'z:' END || p_brand AS x, count(*) AS n_yx FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), c AS (SELECT y, x, n_yx, sum(n_yx) OVER (PARTITION BY y) AS n_y, sum(n_yx) OVER (PARTITION BY x) AS n_x, sum(n_yx) OVER () AS n FROM j),
d AS (SELECT y, x, ln(n_yx::DOUBLE * n / (n_y * n_x)) * n_yx / (n_yx + 2) AS v FROM c), r AS (SELECT y, x, v, row_number() OVER (PARTITION BY y ORDER BY round(v, 9) DESC, x) AS k FROM d WHERE x LIKE 'm:%')
SELECT l_orderkey AS inst, y, round(sum(round(v, 9)::DECIMAL(18, 9)), 6)::DOUBLE AS score FROM lineitem JOIN part ON p_partkey = l_partkey JOIN r ON r.x = 'm:' || p_brand WHERE k <= 8 AND p_size % 2 = 0 GROUP BY 1, 2""")
def slot_predictor(t):
    from ..functions import infogain as ig

    x = t.lineitem.join(t.part, t.lineitem.l_partkey == t.part.p_partkey).select(F.col("l_returnflag").alias("y"), F.concat(F.when(F.col("p_size") % 2 == 0, "m:").otherwise("z:"), "p_brand").alias("x"), F.col("l_orderkey").alias("inst"))
    table = ig.pmi_table(x, "y", "x", 2.0).withColumn("dpmi", F.round("dpmi", 9).cast("decimal(18,9)"))  # sums don't depend on their order
    return retrieval.predicted(x.select("inst", "x"), retrieval.slot_predictor(table, 8)).select("inst", "y", F.round("score", 6).cast("double").alias("score"))


@query("""SELECT page_id, rel FROM pages, (VALUES ('link', 'href='), ('image', '<img')) p(rel, pattern) WHERE regexp_matches(html, pattern)""")
def slot_patterns(t):
    p = t.spark.createDataFrame([("link", "href="), ("image", "<img")], "rel string, pattern string")
    return retrieval.slot_matches(t.pages.select("page_id", F.col("html").alias("text")), p).select("page_id", "rel")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber, l_partkey) AS rank FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_quantity, 0 AS l_partkey FROM lineitem)""")
def mention_ranking(t):
    m = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").distinct().withColumn("mention", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return retrieval.mention_ranking(m, "l_suppkey", "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""WITH f AS (SELECT p_type AS s, p_brand AS v, p_size AS o FROM part), k AS (SELECT DISTINCT p_type AS st, p_size AS ot FROM part) SELECT st AS subj_type, ot AS obj_type, v, sum((s = st AND o = ot)::INT)::BIGINT AS svo, sum((s = st)::INT)::BIGINT AS sv, sum((o = ot)::INT)::BIGINT AS vo FROM k JOIN f ON s = st OR o = ot GROUP BY 1, 2, 3""")
def verb_plausibility(t):
    f = t.part.select(F.col("p_type").alias("s"), F.col("p_brand").alias("v"), F.col("p_size").alias("o"))
    k = t.part.select(F.col("p_type").alias("subj_type"), F.col("p_size").alias("obj_type")).distinct()
    return retrieval.verb_plausibility(f, k)


@query("""SELECT l_orderkey, 1.0 - len(list_intersect(a, b)) / (1.0 + len(list_distinct(list_concat(a, b)))) AS distance FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)""")
def smoothed_jaccard(t):
    x = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return x.select("l_orderkey", (1.0 - scores.smoothed_jaccard(F.col("a"), F.col("b"))).alias("distance"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey AS k, l_returnflag AS n, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2) SELECT f.k, round(sum(f.w * g.w) / (sqrt(sum(f.w * f.w)) * sqrt(sum(g.w * g.w))), 8) AS cos, round(sum(f.w + g.w), 6) AS total, round(max(f.w), 6) AS largest FROM f JOIN g USING (k, n) GROUP BY 1""")
def feature_vectors(t):
    """Feature lists as array columns: cosine, sum, total, maximum."""
    fs = lambda c: F.transform(F.collect_list(F.struct("l_returnflag", F.col(c).cast("double").alias("w"))), lambda s: F.struct(s["l_returnflag"].alias("name"), s["w"].alias("weight")))
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(fs("l_quantity").alias("f"), fs("l_linenumber").alias("g"))
    both = vectors.add(F.col("f"), F.col("g"))
    return x.select("k", F.round(vectors.cosine(F.col("f"), F.col("g"))["cos"], 8).alias("cos"), F.round(vectors.total(both), 6).alias("total"), F.round(vectors.largest(vectors.indexed(F.col("f"))), 6).alias("largest"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_returnflag AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, n) AS r FROM f) SELECT k, string_agg(n, ',' ORDER BY r) AS top FROM r WHERE r <= 2 GROUP BY 1""")
def feature_top(t):
    fs = F.transform(F.collect_list(F.struct("l_returnflag", "l_quantity")), lambda s: F.struct(s["l_returnflag"].alias("name"), s["l_quantity"].alias("weight")))
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(fs.alias("f"))
    return x.select("k", F.array_join(vectors.names(vectors.by_weight(vectors.indexed(F.col("f")), 2)), ",").alias("top"))


@query()
def divisive_clustering(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("feat")).distinct()
    return summarize.divisive(rows, t.orders.select(F.col("o_orderkey").alias("key"), "o_totalprice"), 2, "o_totalprice").select("key", "cluster")


@query()
def coverage_summary(t):
    """A conversation's sentences; a word weighs the number of sentences that have it."""
    parts = F.split("text", r"(?<=[.!?])\s+|\n+")
    s = t.conversations.select(F.col("conv_id").alias("entity"), "turn", F.posexplode(parts).alias("at", "s"))
    s = s.select("entity", F.struct("turn", "at").alias("sent"), F.filter(F.split("s", r"\s+"), lambda w: w != "").alias("words"))
    x = s.select("entity", "sent", F.size("words").alias("length"), F.explode(F.array_distinct(F.transform("words", F.lower))).alias("concept"))
    x = x.withColumn("weight", F.count("*").over(Window.partitionBy("entity", "concept")).cast("double"))
    x = x.withColumn("sent", F.dense_rank().over(Window.partitionBy("entity").orderBy("sent")) - 1)
    return summarize.coverage_summary(x, "entity", 30)


@query()
def knapsack_selection(t):
    return summarize.knapsack(t.part.select("p_brand", "p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("w")), "p_brand", "p_partkey", "p_retailprice", "w", 100.0)


@query()
def diverse_selection(t):
    x = t.part.groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("v"))
    return summarize.diverse(x, "p_brand", "p_type", "v", 3, sep=" ")


def unit(e):
    n = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(e, lambda x: x / n)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10""")
def embedding_search(t):
    """The ten vectors nearest to the first one."""
    e = t.embeddings.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("e"))
    q = e.agg(F.min_by("e", "vec_id").alias("q"))
    dot = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return e.crossJoin(F.broadcast(q)).select("vec_id", dot.alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 6).alias("cosine"))  # one row
