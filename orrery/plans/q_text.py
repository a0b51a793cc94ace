"""Queries of text functions, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import facts
from ..sources import sinks
from ..sources import text as src
from .registry import query, spread

WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}0-9]+'), lambda w: w <> '')"


def words(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("w"))


@query(f"SELECT doc_id, len({WORDS})::INT AS n, len(list_distinct({WORDS}))::INT AS n_distinct FROM documents")
def tokenise(t):
    return words(t).select("doc_id", F.size("w").alias("n"), F.size(text.unique(F.col("w"))).alias("n_distinct"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS g FROM w) SELECT g, count(*) AS n FROM g GROUP BY g HAVING count(*) >= 5""")
def ngram_counts(t):
    g = words(t).select(F.explode(text.ngrams(F.col("w"), 2)).alias("g"))
    return g.groupBy("g").agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]', '0', 'g') AS normal FROM customer")
def normal_numbers(t):
    return t.customer.select("c_custkey", text.normal_numbers(F.col("c_name")).alias("normal"))


@query("SELECT page_id, replace(regexp_replace(trim(html), '\\s+', '_', 'g'), '#', '-HASH-') AS token FROM pages")
def fact_tokens(t):
    return t.pages.select("page_id", text.fact_token(F.col("html")).alias("token"))


@query("SELECT p_partkey, regexp_replace('propbank/' || p_type || '-v-' || p_size, '-[^-]*$', '') AS coarse FROM part")
def coarse_frames(t):
    f = F.concat(F.lit("propbank/"), "p_type", F.lit("-v-"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", text.coarse_frame(f).alias("coarse"))


@query("SELECT p_partkey, 'm.' || p_partkey AS dots, '/m/' || p_partkey AS mid, p_partkey % 2 = 0 AS kb FROM part")
def kb_names(t):
    k = F.col("p_partkey").cast("string")
    url = F.concat(F.when(F.col("p_partkey") % 2 == 0, "http://").otherwise("https://"), F.lit("rdf.example.org/ns/m."), k)
    return t.part.select("p_partkey", text.mid_dots(F.concat(F.lit("/m/"), k)).alias("dots"), text.mid_of_url(url).alias("mid"), text.is_kb_node(url).alias("kb"))


@query("SELECT c_custkey, left(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 8) AS prefix, least(c_custkey + 1, 127)::INT AS n FROM customer")
def uuid_prefixes(t):
    return t.customer.select("c_custkey", text.uuid_prefix(F.col("c_name")).alias("prefix"), text.byte_count(F.col("c_custkey") + 1).cast("int").alias("n"))


@query("""WITH w AS (SELECT c_custkey, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(c_name, '-', ' '), '[0-9]', '0', 'g'), '[^A-Za-z0 ]', '', 'g'), '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM customer)
SELECT c_custkey, array_to_string(list_concat(list_transform(w, lambda x: 'pi:' || x), list_transform(range(1, len(w) + 2), lambda i: 'pb:' || coalesce(list_concat(['BBBB'], w)[i], '') || '_' || coalesce(list_concat(w, ['AAAA'])[i], ''))), ' ') AS feats FROM w""")
def gram_features(t):
    return t.customer.select("c_custkey", F.array_join(text.gram_features(F.col("c_name")), " ").alias("feats"))


@query("SELECT split_part(url, ':', 1) AS ns, count(*) AS n FROM pages GROUP BY 1")
def by_namespace(t):
    return t.pages.groupBy(text.namespace(F.col("url")).alias("ns")).agg(F.count("*").alias("n"))


SPANS = "SELECT l_orderkey, l_linenumber, l_partkey % 10 AS s, l_partkey % 10 + 1 + l_linenumber % 3 AS e, l_suppkey % 10 AS s2, l_suppkey % 10 + 2 AS e2 FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, s < e2 AND s2 < e AS overlap, CASE WHEN e <= s2 THEN 'before' WHEN e2 <= s THEN 'after' WHEN s = s2 AND e = e2 THEN 'same' WHEN s2 <= s AND e <= e2 THEN 'within' WHEN s <= s2 AND e2 <= e THEN 'covers' ELSE 'overlap' END AS rel,
s < e2 AND s2 < e AND NOT (s <= s2 AND e2 <= e) AND NOT (s2 <= s AND e <= e2) AS crossing, least(floor((e - s) / 2), 1)::INT AS bin, ((e - s >= 2)::INT + (e - s >= 3)::INT) AS bucket FROM ({SPANS})""")
def span_algebra(t):
    x = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey % 10 AS s", "l_partkey % 10 + 1 + l_linenumber % 3 AS e", "l_suppkey % 10 AS s2", "l_suppkey % 10 + 2 AS e2")
    a, b = text.span(F.col("s"), F.col("e")), text.span(F.col("s2"), F.col("e2"))
    return x.select("l_orderkey", "l_linenumber", text.overlaps(a, b).alias("overlap"), text.span_relation(a, b).alias("rel"), text.crossing(a, b).alias("crossing"), text.bounded_bin(text.width(a), 2, 1).alias("bin"), text.length_bucket(text.width(a), (2, 3)).alias("bucket"))


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS s, l_linenumber + 1 + l_quantity::INT % 3 AS e FROM lineitem) SELECT q.doc, q.s AS q_start, q.e AS q_end, a.s AS "start", a.e AS "end" FROM s q JOIN s a ON q.doc = a.doc AND a.s <= q.s AND q.e <= a.e""")
def span_index(t):
    s = t.lineitem.selectExpr("l_orderkey AS doc", "l_linenumber AS start", "l_linenumber + 1 + int(l_quantity) % 3 AS end")
    return facts.span_index(s, s, "contains")


@query("""SELECT conv_id, list_sort(list(DISTINCT role))[1] AS first_role, count(*) AS n FROM conversations GROUP BY 1""")
def role_sets(t):
    return t.conversations.groupBy("conv_id").agg(F.array_min(F.collect_set("role")).alias("first_role"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, (arg_min(role, (-n, role))) AS role FROM c GROUP BY 1""")
def majority_tag(t):
    return t.conversations.groupBy("conv_id").agg(text.majority(F.collect_list("role")).alias("role"))


@query("""SELECT conv_id, turn, role IN ('user') AS starts FROM conversations""")
def verb_filter(t):
    tags = F.array(F.when(F.col("role") == "user", "N").otherwise("V"), F.lit("VB"))
    return t.conversations.select("conv_id", "turn", text.has_main_verb(tags).alias("starts"))


@query("""SELECT doc_id, regexp_extract(source, '([0-9]+)$', 1)::INT AS idx, DATE '2009-01-01' + (doc_id % 28)::INT AS date FROM documents""")
def gigaword_ids(t):
    gid = F.concat(F.lit("NYT_ENG_200901"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("."), F.regexp_extract("source", "([0-9]+)$", 1))
    return t.documents.select("doc_id", src.gigaword_id(gid).alias("g")).select("doc_id", F.col("g.index").alias("idx"), F.col("g.date").alias("date"))


@query("""SELECT a.doc_id, b.doc_id % 28 = (a.doc_id * 3) % 28 AS same_day FROM documents a JOIN documents b USING (doc_id)""")
def same_day(t):
    gid = lambda n: src.gigaword_id(F.concat(F.lit("NYT_ENG_200901"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(".0001")))
    return t.documents.select("doc_id", src.same_time(gid(F.col("doc_id")), gid(F.col("doc_id") * 3), "day").alias("same_day"))


@query("SELECT doc_id FROM documents WHERE source >= 'src1' AND source < 'src2'")
def id_range(t):
    return t.documents.where(src.between_ids(F.col("source"), "src1", "src2")).select("doc_id")


@query("SELECT 'x' AS cmd, 'order_by' AS rel, o_orderkey::VARCHAR AS o, replace(o_orderpriority, ' ', '_') AS p FROM orders")
def fact_scan(t):
    """Facts written as lines and scanned again."""
    f = t.orders.select(F.lit("x").alias("cmd"), F.lit("order_by").alias("rel"), F.array(F.col("o_orderkey").cast("string"), text.fact_token(F.col("o_orderpriority"))).alias("args"))
    back = src.fact_lines(sinks.fact_text(f).select(F.lit("f").alias("file"), F.monotonically_increasing_id().alias("ord"), F.concat("value", F.lit("  # note")).alias("value")))
    return back.select("cmd", "rel", F.col("args")[0].alias("o"), F.col("args")[1].alias("p"))


@query("SELECT conv_id::VARCHAR AS docid, count(*) AS n FROM conversations GROUP BY 1")
def many_doc_scan(t):
    """Turns as a many-document file: a startdoc line before each conversation."""
    head = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("turn")).select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat(F.lit("startdoc "), "conv_id").alias("value"))
    body = t.conversations.select("conv_id", "turn", F.concat(F.lit("x turn "), F.col("turn").cast("string"), F.lit(" "), "role").alias("value"))
    lines = head.unionByName(body).select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), "value")
    return src.many_docs(src.fact_lines(lines)).groupBy("docid").agg(F.count("*").alias("n"))


@query("SELECT 'role' AS rel, turn::VARCHAR AS at, role AS v, count(*) AS n FROM conversations GROUP BY 2, 3")
def column_facts(t):
    tok = t.conversations.select(F.col("conv_id").alias("file"), F.lit(0).alias("sent"), F.col("turn").alias("at"), "role")
    return src.column_facts(tok, ["role"]).groupBy("rel", F.col("args")[0].alias("at"), F.col("args")[1].alias("v")).agg(F.count("*").alias("n"))


@query("""SELECT 'http://x/' || c_custkey AS subj, 'http://v/bal' AS verb, round(c_acctbal)::BIGINT AS obj_long, 'integer' AS kind FROM customer""")
def triple_scan(t):
    num = F.round("c_acctbal").cast("long").cast("string")
    line = F.concat(F.lit("<http://x/"), F.col("c_custkey").cast("string"), F.lit('> <http://v/bal> "'), num, F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer> .'))
    return src.triples(t.customer.select(line.alias("value"))).select("subj", "verb", "obj_long", "kind")


@query("SELECT event_id, 1.0::DOUBLE AS y, 2::INT AS n_ns, event_type AS f FROM events")
def vw_scan(t):
    line = F.concat(F.lit("1 |a "), "event_type", F.lit(" |b u"), F.col("user_id").cast("string"))
    rows = t.events.select(F.lit("f").alias("file"), F.col("event_id").alias("ord"), line.alias("value"))
    out = src.vw_lines(rows)
    kept = src.keep_namespaces(out.withColumn("n_ns", F.size("ns")), ["a"])
    return kept.select(F.col("ord").alias("event_id"), "y", "n_ns", F.expr("ns[0].feats[0]").alias("f"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::INT AS t, l_suppkey::INT AS f FROM lineitem")
def feature_pack(t):
    """Features packed into binary and unpacked again."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.array(F.struct(F.col("l_partkey").cast("int").alias("t"), F.col("l_suppkey").cast("int").alias("f"))).alias("feats"))
    back = sinks.unpacked_features(sinks.binary_features(x).drop("feats"))
    return back.select("l_orderkey", "l_linenumber", F.col("feats")[0]["t"].alias("t"), F.col("feats")[0]["f"].alias("f"))


@query("SELECT p_brand AS k, list_sort(list(DISTINCT p_type)) AS vs FROM part GROUP BY 1")
def key_lists(t):
    rows = t.part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("ord"), F.concat_ws("\t", "p_brand", "p_type").alias("value"))
    return src.key_lists(rows, 0, 1, dedup=True).select("k", F.array_sort("vs").alias("vs"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'memo' ELSE 'fetched' END AS how FROM documents")
def memoised_fetch(t):
    d = t.documents.select("doc_id")
    memo = d.where("doc_id % 2 = 0").withColumn("how", F.lit("memo"))
    return src.memoised(d, memo, lambda missing: missing.withColumn("how", F.lit("fetched")), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def profile_filter(t):
    """English documents come from one newswire, others from another; the medium profile takes the first."""
    gid = F.concat(F.when(F.col("lang") == "en", "APW_ENG_2009").otherwise("NYT_ENG_2009"), F.lit("0101.0001"))
    return t.documents.where(src.in_profile(gid, "medium")).select("doc_id")
