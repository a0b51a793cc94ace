"""One query for each operator that no other query shows: samples, text, paths, templates, retrieval, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, scores, text
from ..functions import templates as tp
from ..operators import decide, evaluate, extras, facts, learn, retrieval, sample, summarize
from ..sources import text as src
from ..streaming import state
from .lineage import scratch_path
from .q_features import TOKENS, extracted, sentences
from .q_retrieval import F2T, TRIAGE, index, query_feats, tables
from .q_rows import LINES_OF, S, as_lines, lines_of
from .registry import query
from .rules import Program, generated, parse_rule

UNIT = "({0} * 7919 + 104729) % 1000003 / 1000003.0"


def r8(c, name):
    return F.round(c, 8).alias(name)


# samples

@query(f"SELECT doc_id FROM documents WHERE {UNIT.format('doc_id')} < 0.3")
def split_random(t):
    return sample.bernoulli(t.documents.select("doc_id"), S("doc_id"), 0.3, draw=sample.arithmetic_unit(S("doc_id")))


@query(f"SELECT doc_id, quality FROM labels WHERE (quality = 1 AND {UNIT.format('doc_id')} < 0.2) OR (quality = 0 AND {UNIT.format('doc_id')} < 0.9)")
def sample_pairs(t):
    """Rows drawn at a rate for each label."""
    return sample.sampled_pairs(t.labels.select("doc_id", "quality"), "quality", {1: 0.2, 0: 0.9}, S("doc_id"), draw=sample.arithmetic_unit(S("doc_id")))


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {UNIT.format('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 20")
def sample_reservoir(t):
    return sample.reservoir(t.documents.select("lang", "doc_id"), ["lang"], S("doc_id"), 20, draw=sample.arithmetic_unit(S("doc_id")))


@query(f"SELECT user_id, arg_min(event_id, -ln({UNIT.format('event_id')} + 1e-7) / value) AS event_id FROM events WHERE value > 0 GROUP BY 1")
def sample_weighted(t):
    return sample.weighted_choice(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", S("value"), draw=sample.arithmetic_unit(S("event_id")) + 1e-7)


@query(f"SELECT arg_min(user_id, -ln({UNIT.format('user_id')} + 1e-7) / n) AS user_id FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def sample_weighted_key(t):
    """A key drawn in proportion to its rows."""
    return sample.weighted_key(t.events, "user_id", draw=sample.arithmetic_unit(S("user_id")) + 1e-7)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def shard_filter(t):
    return sample.sharded(t.documents.select("doc_id"), S("doc_id"), 4, 1, hashed=S("doc_id"))


@query("SELECT r_name AS a, n_name AS b, row_number() OVER (ORDER BY r_name, n_name) - 1 AS job FROM region, nation")
def job_array(t):
    """All combinations of two options, by job number."""
    out = sample.grid(a=t.region.select(S("r_name").alias("a")), b=t.nation.select(S("n_name").alias("b")))
    return out.select("a", "b", S("job").cast("long").alias("job"))


@query(f"SELECT s AS set, n_name FROM nation, range(0, 40) r(s) WHERE {UNIT.format('(s * 31 + n_nationkey)')} < 5 / 25".replace("AS set", 'AS "set"'))
def random_feature_sets(t):
    """Forty sets of about five names each."""
    return sample.random_products(t.nation.select("n_name", "n_nationkey"), "n_name", 5.0, 40, draw=sample.arithmetic_unit(S("set") * 31 + S("n_nationkey")))


@query(f"""WITH y AS (SELECT k, p, i, f, row_number() OVER (PARTITION BY k, f = 'R' ORDER BY q DESC, i) AS r FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i FROM ({LINES_OF}))) SELECT k, 'm' || k % 3 || '_m9#' || coalesce(string_agg('w' || p, '#' ORDER BY i) FILTER (WHERE f <> 'R' AND r <= 2), '') AS key FROM y GROUP BY k""")
def sentence_keys(t):
    """Mentioned entities and the two rarest words outside of mentions, in the order of the sentence."""
    rows = F.array_sort(F.collect_list(F.struct("n", "p", "q", "f")))
    x = lines_of(t).groupBy("k").agg(rows.alias("l"))
    words = F.transform("l", lambda s: F.concat(F.lit("w"), s["p"].cast("string")))
    idf = F.transform("l", lambda s: F.when(s["f"] != "R", s["q"].cast("double")))
    return x.select("k", text.sentence_key(words, idf, F.array(F.concat(F.lit("m"), (S("k") % 3).cast("string")), F.lit("m9"))).alias("key"))


# text

MENTION = "regexp_replace(regexp_replace(c_name, '[0-9]', '0', 'g'), '[^A-Za-z0 ]', '', 'g')"


@query(f"""WITH m AS (SELECT c_custkey, {MENTION} AS w FROM customer), f AS (SELECT c_custkey, unnest(['pi:' || lower(w), 'pb:BBBB_' || lower(w), 'pb:' || lower(w) || '_AAAA', 'h:' || w, 'hi:' || lower(w)]) AS f FROM m)
SELECT c_custkey, f, CASE WHEN f LIKE 'hi:%' THEN 20.0 WHEN f LIKE 'h:%' THEN 30.0 WHEN f LIKE 'pb:%' THEN 5.0 ELSE 1.0 END::DOUBLE AS weight FROM f""")
def mention_features(t):
    """Grams and headwords of a name of one word, by prefix weight; no feature here is a stop feature."""
    f = text.mention_features(S("c_name"), F.slice(text.mention_words(S("c_name")), 1, 2))
    return t.customer.select("c_custkey", F.explode(f).alias("f")).select("c_custkey", "f", text.feature_weight(S("f")).alias("weight"))


@query("SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 15))::BIGINT >> 29 AS h FROM part")
def one_way_hash(t):
    return t.part.select("p_partkey", text.digest_hash(S("p_name")).alias("h"))


@query("SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 3))::BIGINT AS a, ('0x' || substr(md5(p_name), 7, 3))::BIGINT AS b FROM part")
def digest_slices(t):
    """The first and the third slice of three digits of a digest."""
    return t.part.select("p_partkey", text.digest_slice(S("p_name"), 0, 3).alias("a"), text.digest_slice(S("p_name"), 2, 3).alias("b"))


@query("SELECT c_custkey, replace(c_name, '#', '-HASH-') || '_of_' || c_mktsegment AS token FROM customer")
def token_norm(t):
    return t.customer.select("c_custkey", text.fact_token(F.concat(F.lit("  "), "c_name", F.lit("  of\t "), "c_mktsegment", F.lit(" "))).alias("token"))


@query("SELECT s_suppkey, 'm.' || s_suppkey || '.x' AS dots FROM supplier")
def mid_names(t):
    return t.supplier.select("s_suppkey", text.mid_dots(F.concat(F.lit("/m/"), S("s_suppkey").cast("string"), F.lit("/x"))).alias("dots"))


@query("SELECT s_suppkey, '/m/0' || s_suppkey AS a, '/m/0' || s_suppkey AS b FROM supplier")
def mid_of_urls(t):
    k = F.concat(F.lit("0"), S("s_suppkey").cast("string"))
    return t.supplier.select("s_suppkey", text.mid_of_url(F.concat(F.lit("<http://kb.example.org/ns/m."), k, F.lit(">"))).alias("a"), text.mid_of_url(F.concat(F.lit("http://kb.example.org/m/"), k)).alias("b"))


@query("SELECT l_partkey, least(count(*), 127)::INT AS n FROM lineitem GROUP BY 1")
def count_codec(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("c")).select("l_partkey", text.byte_count(S("c")).cast("int").alias("n"))


@query("SELECT page_id, replace(replace(html, '<p>', '[P]'), '</p>', '[/P]') AS html FROM pages")
def find_replace(t):
    return src.substituted(t.pages.select("page_id", "html"), "<(/?)p>", "[$1P]", "html")


# scores

@query("SELECT o_orderkey, round(1001 / (1000 + o_totalprice), 8) AS prior FROM orders")
def frequency_prior(t):
    return t.orders.select("o_orderkey", r8(scores.frequency_prior(S("o_totalprice")), "prior"))


@query("""SELECT at, n FROM (VALUES (0, 571), (1, 286), (2, 143)) v(at, n)""".replace("at,", '"at",'))
def budget_split(t):
    return t.spark.createDataFrame(list(enumerate(scores.split_budget(1000, 3, 0.5))), "at int, n int")


@query("SELECT lang, round(ln((1000 + 1) / (count(*) + 1)), 8) AS idf FROM documents GROUP BY 1")
def cluster_idf(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).select("lang", r8(scores.cluster_idf(F.lit(1000), S("n")), "idf"))


@query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey % 5) AS x, list(DISTINCT l_partkey % 5) AS y FROM lineitem GROUP BY 1) SELECT k, round(len(list_intersect(x, y)) / (1 + len(list_distinct(list_concat(x, y)))), 8) AS similarity FROM a""")
def situation_similarity(t):
    x = t.lineitem.groupBy(S("l_orderkey").alias("k")).agg(F.collect_set(S("l_suppkey") % 5).alias("x"), F.collect_set(S("l_partkey") % 5).alias("y"))
    return x.select("k", r8(scores.smoothed_jaccard(S("x"), S("y")), "similarity"))


@query("SELECT event_id, round(value + value * 20 / sqrt(event_id % 7 + 1) + 1 + 2 + 3, 6) AS score FROM events")
def situation_search(t):
    n = S("event_id") % 7
    return t.events.select("event_id", F.round(retrieval.situation_score(S("value"), S("value"), n, F.lit(1), F.lit(2), F.lit(3)), 6).alias("score"))


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN h - 2.5 ELSE h + CASE WHEN value / 100 > 0.95 THEN 0.75 ELSE 0.25 * (value / 100 - 0.5) END + 0.5 * (value / 200 - 0.5) + 0.1 + 0.2 END, 6) AS score
FROM (SELECT *, 0.5 * ((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 4 = 0)::INT) AS h FROM events)""")
def entity_link_score(t):
    k = S("event_id")
    same = [k % i == 0 for i in (2, 3, 4)]
    s = scores.entity_link_score(*same, F.lit(False), k % 5 == 0, S("value") / 100, S("value") / 200, F.lit(0.1), F.lit(0.2))
    return t.events.select("event_id", F.round(s, 6).alias("score"))


@query("SELECT event_id, round(10 * (-0.5 + 11 / (10 + 1 / (value + 1)) + 0.25), 6) AS interest FROM events WHERE value >= 0")
def related_interest(t):
    return t.events.where("value >= 0").select("event_id", F.round(scores.related_interest(F.lit(-0.5), S("value") + 1, F.lit(0.25)), 6).alias("interest"))


@query("SELECT event_id, round(0.3 * value + 0.5 * (event_id % 3) + 0.2, 6) AS score FROM events")
def beam_coefficients(t):
    """The weighted sum of several scores of a step."""
    named = {"model": S("value"), "loss": S("event_id") % 3, "rand": F.lit(1.0)}
    return t.events.select("event_id", F.round(decide.weighted("0.3*model+0.5*loss+0.2*rand", named), 6).alias("score"))


@query(f"""SELECT k, arg_min(i, (CASE WHEN i = 0 THEN 2.0 ELSE 1.0 END * (1 - q / 100.0), i))::INT AS choice FROM (SELECT k, q, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i FROM ({LINES_OF})) GROUP BY 1""")
def least_loss(t):
    """The choice of least expected cost; choosing nothing wrongly costs twice as much."""
    probs = F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda s: s["q"] / 100.0)
    return lines_of(t).groupBy("k").agg(probs.alias("p")).select("k", scores.expected_loss_choice(S("p"), 1.0, 2.0).alias("choice"))


# sentences: the lines of an order, each depending on the one before

TOKEN_SQL = f"x AS (SELECT k, p, q, f, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY k) AS len, CASE WHEN q % 10 = 0 THEN 'IN' WHEN f = 'A' THEN 'NNP' WHEN f = 'N' THEN 'JJ' ELSE 'VBZ' END AS pos FROM ({LINES_OF}))"


def orders_as_sentences(t):
    rows = F.array_sort(F.collect_list(F.struct("n", "p", "q", "f")))
    pos = lambda s: F.when(s["q"] % 10 == 0, "IN").when(s["f"] == "A", "NNP").when(s["f"] == "N", "JJ").otherwise("VBZ")
    tok = F.transform(rows, lambda s, i: F.struct(F.concat(F.lit("w"), s["p"].cast("string")).alias("word"), F.concat(F.lit("w"), s["p"].cast("string")).alias("lemma"), pos(s).alias("pos"), F.concat(F.lit("d"), s["f"]).alias("deprel"), (i - 1).cast("int").alias("head")))
    return lines_of(t).groupBy("k").agg(tok.cast(TOKENS).alias("tokens"))


def tags(x="tokens"):
    return F.transform(x, lambda s: s["pos"])


@query(f"""WITH {TOKEN_SQL}, y AS (SELECT k, i, pos, coalesce(string_agg('>d' || f, '') FILTER (WHERE i > 0) OVER (PARTITION BY k ORDER BY i), '') AS path FROM x) SELECT k, path, pos AS backoff, i::INT AS "end" FROM y WHERE i BETWEEN 1 AND 3 AND pos IN ('NNP', 'JJ')""")
def attribute_paths(t):
    """Paths from the first token to names, numbers and adjectives at most three steps away."""
    return orders_as_sentences(t).select("k", F.explode(paths.attribute_paths(S("tokens"), F.lit(0), 3)).alias("a")).select("k", "a.path", "a.backoff", "a.end")


@query(f"WITH {TOKEN_SQL} SELECT k, i::INT AS i, round(3 / (2 + i), 8) AS path_score, CASE WHEN pos = 'NNP' THEN 1.0 ELSE 0.5 END::DOUBLE AS endpoint FROM x")
def attribute_scores(t):
    x = orders_as_sentences(t).select("k", F.posexplode(tags()).alias("i", "pos"))
    return x.select("k", "i", r8(scores.path_score(S("i")), "path_score"), text.endpoint_score(S("pos")).alias("endpoint"))


@query(f"""WITH {TOKEN_SQL} SELECT k, 0 AS "start", 1 + max((i = 1 AND f = 'A')::INT) AS "end" FROM x GROUP BY k""")
def noun_phrases(t):
    """The first token with its modifier beside it."""
    return orders_as_sentences(t).select("k", paths.noun_phrase(S("tokens"), F.lit(0), ("dA",)).alias("s")).select("k", "s.start", "s.end")


@query(f"WITH {TOKEN_SQL} SELECT k, least(1, max(i))::INT AS head FROM x GROUP BY k")
def head_words(t):
    """The token of a span that is nearest to the root: here the first of all but the root."""
    x = orders_as_sentences(t)
    n = F.size("tokens")
    return x.select("k", text.head_of(F.least(F.lit(1), n - 1), n, paths.depths(S("tokens"))).alias("head"))


@query(f"""WITH {TOKEN_SQL}, c AS (SELECT *, min(CASE WHEN pos = 'IN' THEN i END) OVER (PARTITION BY k) AS cut FROM x) SELECT k, coalesce(max(i) FILTER (WHERE pos = 'NNP' AND (cut IS NULL OR i < cut)), min(i) FILTER (WHERE pos = 'VBZ'), max(i))::INT AS head FROM c GROUP BY k""")
def target_heads(t):
    """The last noun before a preposition, else the first verb, else the last token."""
    return orders_as_sentences(t).select("k", text.target_head(tags(), F.lit(0), F.size("tokens")).cast("int").alias("head"))


@query(f"""WITH {TOKEN_SQL}, l AS (SELECT k, list_concat(['^'], list('d' || f ORDER BY i), ['$']) AS l FROM x GROUP BY k), g AS (SELECT unnest(list_transform(range(1, len(l)), lambda j: l[j] || ' ' || l[j + 1])) AS gram FROM l) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def path_grams(t):
    labels = F.transform("tokens", lambda s: s["deprel"])
    g = orders_as_sentences(t).select(F.explode(paths.path_grams(labels, 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKEN_SQL}, y AS (SELECT k, i, left(pos, 1) AS l FROM x), z AS (SELECT *, i - row_number() OVER (PARTITION BY k, l ORDER BY i) AS g FROM y), u AS (SELECT k, l, min(i) AS i, count(*) AS n FROM z GROUP BY k, l, g) SELECT k, string_agg(l || CASE WHEN n > 1 THEN '+' ELSE '' END, ' ' ORDER BY i) AS pattern FROM u GROUP BY k""")
def tag_patterns(t):
    return orders_as_sentences(t).select("k", text.pos_pattern(tags()).alias("pattern"))


@query(f"WITH {TOKEN_SQL} SELECT k, ((max(len) >= 2)::INT + (max(len) >= 4)::INT + (max(len) >= 6)::INT) AS bucket FROM x GROUP BY k")
def length_buckets(t):
    return orders_as_sentences(t).select("k", text.length_bucket(F.size("tokens"), (2, 4, 6)).alias("bucket"))


@query("""SELECT CASE WHEN e <= s2 THEN 'before' WHEN e2 <= s THEN 'after' WHEN s = s2 AND e = e2 THEN 'same' WHEN s2 <= s AND e <= e2 THEN 'within' WHEN s <= s2 AND e2 <= e THEN 'covers' ELSE 'overlap' END AS rel, count(*) AS n
FROM (SELECT l_partkey % 12 AS s, l_partkey % 12 + 2 AS e, l_suppkey % 12 AS s2, l_suppkey % 12 + 1 + l_linenumber AS e2 FROM lineitem) GROUP BY 1""")
def span_positions(t):
    x = t.lineitem.selectExpr("l_partkey % 12 AS s", "l_partkey % 12 + 2 AS e", "l_suppkey % 12 AS s2", "l_suppkey % 12 + 1 + l_linenumber AS e2")
    return x.groupBy(text.span_relation(text.span(S("s"), S("e")), text.span(S("s2"), S("e2"))).alias("rel")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOKEN_SQL} SELECT k, coalesce(max(CASE WHEN i = 1 THEN f = 'R' END), false) AS passive, coalesce(max(CASE WHEN i = 1 THEN f = 'N' END), true) AS lacks_subject, coalesce(max(CASE WHEN i = 1 THEN CASE f WHEN 'A' THEN 'nsubj' WHEN 'R' THEN 'nsubjpass' ELSE 'obj' END END), '') AS dependents FROM x GROUP BY k""")
def predicate_syntax(t):
    """Voice, missing subject and the labels of dependents of the first token."""
    named = F.transform("tokens", lambda s: s.withField("deprel", F.when(s["deprel"] == "dA", "nsubj").when(s["deprel"] == "dR", "nsubjpass").otherwise("obj")))
    x = orders_as_sentences(t).withColumn("tokens", named)
    verb = F.lit(0)
    return x.select("k", paths.passive(S("tokens"), verb).alias("passive"), paths.lacks_subject(S("tokens"), verb).alias("lacks_subject"), F.array_join(paths.dependents(S("tokens"), verb), " ").alias("dependents"))


CHAINS = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1"


def chains(t):
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("labels_a"))
    x = c.withColumn("parents_a", F.transform("labels_a", lambda _, i: (i - 1).cast("int"))).withColumn("labels_b", F.slice("labels_a", 1, 3)).withColumn("parents_b", F.slice("parents_a", 1, 3))
    return x.select(S("conv_id").alias("key"), "labels_a", "parents_a", "labels_b", "parents_b")


@query(f"SELECT conv_id AS key, greatest(n - 3, 0)::DOUBLE AS distance FROM ({CHAINS})")
def tree_distances(t):
    """A chain of turns against its first three: every further turn is one edit."""
    return summarize.tree_distances(chains(t))


@query(f"SELECT conv_id AS key, round(greatest(n - 3, 0) / (n + least(n, 3)), 8)::DOUBLE AS distance FROM ({CHAINS})")
def tree_edits_normal(t):
    return summarize.tree_distances(chains(t), normal=True).select("key", F.round("distance", 8).alias("distance"))


@query("""WITH l AS (SELECT p_type AS lemma, list_sort(list(DISTINCT p_brand)) AS verbs FROM part WHERE p_size < 5 GROUP BY 1) SELECT p_partkey, p_type AS lemma, verbs FROM part LEFT JOIN l ON lemma = p_type""")
def inverse_nominal(t):
    lexicon = t.part.where("p_size < 5").select(S("p_type").alias("noun"), S("p_brand").alias("verb"))
    return extras.inverse_nominal(t.part.select("p_partkey", S("p_type").alias("lemma")), lexicon).select("p_partkey", "lemma", "verbs")


@query(f"""WITH {TOKEN_SQL}, y AS (SELECT k, string_agg('d' || f || '<', '' ORDER BY i DESC) FILTER (WHERE i > 0) AS path, max(len) AS len FROM x GROUP BY k) SELECT path, count(*) AS n FROM y WHERE len BETWEEN 2 AND 4 GROUP BY 1""")
def argument_path_index(t):
    """Paths from the last token to the first, of at most three steps, and how often each was seen."""
    last = F.size("tokens") - 1
    p = orders_as_sentences(t).select(paths.path_text(S("tokens"), last, F.lit(0), most=3).alias("path"))
    return p.where("path <> ''").groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {TOKEN_SQL} SELECT k, sum(least(10, len - i))::BIGINT AS every, count(*) AS dependency FROM x GROUP BY k")
def argument_span_modes(t):
    """Candidate spans by mode: all short ones, and the subtrees, one for each token of a chain."""
    x = orders_as_sentences(t)
    return x.select("k", F.size(paths.argument_spans(S("tokens"), F.lit(0), "all")).cast("long").alias("every"), F.size(paths.argument_spans(S("tokens"), F.lit(0), "dependency")).cast("long").alias("dependency"))


# templates

@query("""WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS j FROM conversations), o AS (SELECT conv_id, list(w ORDER BY turn, j) AS w, list(role ORDER BY turn, j) AS r FROM w GROUP BY 1)
SELECT conv_id, 'Span1-First-Word' AS template, w[1] AS x FROM o UNION ALL SELECT conv_id, 'Span2-Last-Word3', left(w[-1], 3) FROM o UNION ALL SELECT conv_id, 'Span1-Right-Pos', r[3] FROM o WHERE len(r) > 2 UNION ALL SELECT conv_id, 'Span1-Width', least(2, len(r))::VARCHAR FROM o""")
def basic_templates(t):
    return extracted(sentences(t), "Span1-First-Word + Span2-Last-Word3 + Span1-Right-Pos + Span1-Width")


@query("SELECT r_name || '.' || n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey")
def template_product_pruned(t):
    """Products joined by a point; five names a side are too few for any to be left out."""
    g = t.region.join(t.nation, S("n_regionkey") == S("r_regionkey")).groupBy("r_name").agg(F.collect_set("n_name").alias("ns"))
    return g.select(F.explode(tp.pruned_product(tp.one(S("r_name")), S("ns"))).alias("x"))


@query("""SELECT product, factor, name FROM (VALUES (0, 0, 'a'), (0, 1, 'b'), (1, 0, 'c'), (2, 0, 'd'), (2, 1, 'a'), (2, 2, 'c')) v(product, factor, name)""")
def template_parse(t):
    rows = [(i, j, n) for i, p in enumerate(tp.parse("a*b + c + d * a * c")) for j, n in enumerate(p)]
    return t.spark.createDataFrame(rows, "product int, factor int, name string")


@query("""SELECT "order", count(*) AS n FROM (VALUES (2), (1), (3), (1)) v("order") GROUP BY 1""")
def product_orders(t):
    """How many products of each order a feature set has."""
    x = t.spark.createDataFrame([(len(p),) for p in tp.parse("a*b + c + d * a * c + e")], "order long")
    return x.groupBy("order").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(p_retailprice, 4)::DOUBLE AS score, p_size::INT AS arity, p_brand AS a, p_type AS b FROM part")
def feature_set_scan(t):
    k = lambda c: S(c).cast("string")
    line = F.concat_ws("\t", F.round("p_retailprice", 4).cast("string"), F.lit("0.5"), F.lit("1.5"), k("p_partkey"), k("p_size"), F.lit("1"), F.lit("x"), F.concat("p_brand", F.lit("*"), "p_type"))
    out = src.feature_set_file(as_lines(t.part, "f", S("p_partkey"), line))
    return out.select(S("selectivity").cast("long").alias("p_partkey"), "score", "arity", S("templates")[0].alias("a"), S("templates")[1].alias("b"))


@query("SELECT p_partkey, ('0x' || substr(md5(p_type), 1, 15))::BIGINT % 64 AS h FROM part")
def hash_featurizer(t):
    return t.part.select("p_partkey", tp.hashed(S("p_type"), 64, portable=True).alias("h"))


@query("SELECT l_orderkey, l_linenumber, p_size * 10 + length(p_brand) AS feature FROM lineitem JOIN part ON p_partkey = l_partkey")
def cached_features(t):
    """Product features computed once a part and looked up by its lines."""
    cache = t.part.select(S("p_partkey").alias("item"), tp.flat_index([S("p_size").cast("long"), F.length("p_brand").cast("long")], [100, 10]).alias("feature"))
    return t.lineitem.join(cache, S("l_partkey") == S("item")).select("l_orderkey", "l_linenumber", "feature")


PLACE_WALKS = """SELECT 'c' || c_custkey AS node, '/lives=n' || c_nationkey AS feature FROM customer UNION ALL SELECT 'c' || c_custkey, '/lives/in=r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def place_walks(t):
    node = lambda p, c: F.concat(F.lit(p), S(c).cast("string"))
    e = t.customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"), F.lit("lives").alias("rel"))
    e = e.unionByName(t.nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("in").alias("rel")))
    return extras.walk_features(e, t.customer.select(node("c", "c_custkey").alias("node")), 2)


@query(PLACE_WALKS)
def graph_walk_features(t):
    """Labels along walks of the fact graph, with the node each ends at."""
    return place_walks(t)


@query(f"SELECT feature, n FROM (SELECT feature, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, feature) AS r FROM ({PLACE_WALKS}) GROUP BY 1) WHERE r <= 5")
def walk_explanation(t):
    """The walk features that most nodes share: a top-5 report."""
    x = place_walks(t).groupBy(S("feature").alias("x")).agg(F.count("*").alias("n")).withColumn("template", F.lit("walk"))
    return tp.top_k(x, 5).select(S("x").alias("feature"), "n")


@query(f"SELECT node, feature FROM (SELECT node, feature, row_number() OVER (PARTITION BY node ORDER BY length(feature), feature) AS r FROM ({PLACE_WALKS})) WHERE r <= 1")
def walk_sample(t):
    """One walk feature a node, drawn by an order that SQL can repeat."""
    return sample.reservoir(place_walks(t), ["node"], S("feature"), 1, draw=F.length("feature"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 7 + l_linenumber) * 4 + l_suppkey % 4 AS state, true AS back FROM lineitem WHERE l_linenumber < 7")
def state_index(t):
    """(target, role, span) to one number and back."""
    cards = [1 << 30, 7, 4]
    v = [S("l_partkey"), S("l_linenumber").cast("long"), S("l_suppkey") % 4]
    x = t.lineitem.where("l_linenumber < 7").withColumn("state", tp.flat_index(v, cards))
    back = tp.unflat_index(S("state"), cards)
    return x.select("l_orderkey", "l_linenumber", "state", ((back[0] == v[0]) & (back[1] == v[1]) & (back[2] == v[2])).alias("back"))


# facts, factors, learning

@query("SELECT o_custkey AS c, l_partkey * 2 AS p, round(l_quantity / 50, 6) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def generated_facts(t):
    """What matches a rule's left side becomes new facts with values of their own and a score."""
    p = Program().relation("order_by", ["c", "o", "s"], t.orders.select(S("o_custkey").alias("c"), S("o_orderkey").alias("o"), S("o_orderstatus").alias("s")))
    p.relation("item", ["o", "p", "q"], t.lineitem.select(S("l_orderkey").alias("o"), S("l_partkey").alias("p"), S("l_quantity").alias("q")))
    rule = parse_rule("order_by(c, o, 'F') & item(o, p, q) => bought(c, p)")
    return generated(rule, p.catalog, p.facts, {"c": S("c"), "p": S("p") * 2}, F.round(S("q") / 50, 6))


@query(f"""WITH s AS (SELECT k, n, q FROM ({LINES_OF}) WHERE q % 3 <> 0 AND q % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC, n) AS r FROM s) SELECT k, n AS sent, sum(q) OVER (PARTITION BY k)::DOUBLE AS value FROM r WHERE r <= 3 AND q > 0""")
def sentence_summaries(t):
    """Sentences with a verb that doesn't come first; weights outside of an entity's three largest are 0, and those sentences are not needed."""
    q = S("q")
    tags = F.when(q % 3 == 0, F.array(F.lit("NN"))).when(q % 2 == 1, F.array(F.lit("VB"), F.lit("NN"))).otherwise(F.array(F.lit("NN"), F.lit("VB")))
    x = lines_of(t).select("k", S("n").alias("sent"), tags.alias("tags"), q.cast("double").alias("weight"))
    inst = x.select("k", "sent", F.lit(1).alias("length"), F.concat(F.lit("c"), "sent").alias("concept"), "weight")
    return summarize.summaries(x.select("k", "sent", "tags"), inst, "k", 1000, 3).select("k", "sent", "value")

@query(f"SELECT a.f AS role_a, b.f AS role_b, count(*) AS n FROM ({LINES_OF}) a JOIN ({LINES_OF}) b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2")
def role_pairs(t):
    """Roles that occur together in an instance."""
    return decide.global_features(lines_of(t), ["k"], "f")[1]


@query(f"SELECT k, count(*) AS n_args FROM ({LINES_OF}) GROUP BY 1")
def argument_numbers(t):
    return decide.global_features(lines_of(t), ["k"], "f")[0]


@query("""WITH w AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DECIMAL(18, 0) AS w FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS inst, y, sum(w)::BIGINT AS score FROM lineitem JOIN w ON x = l_returnflag GROUP BY 1, 2""")
def local_factor(t):
    """A candidate's score is the sum of its features' weights."""
    w = t.lineitem.groupBy(S("l_returnflag").alias("x"), S("l_linestatus").alias("y")).agg(F.count("*").alias("dpmi"))
    return retrieval.predicted(t.lineitem.select(S("l_orderkey").alias("inst"), S("l_returnflag").alias("x")), w).select("inst", "y", "score")


@query("SELECT event_type AS feature, round(sum(value), 4) AS final, round(sum(value * (1 - event_id / (SELECT count(*) FROM events))), 4) AS average FROM events GROUP BY 1")
def averaged_weights(t):
    """Updates as rows, the average over all steps as one aggregate."""
    u = t.events.select(S("event_type").alias("feature"), (S("event_id") + 1).alias("step"), S("value").alias("delta"))
    out = learn.averaged_weights(u, t.events.count())
    return out.select("feature", F.round("final", 4).alias("final"), F.round("average", 4).alias("average"))


@query()
def perceptron_mixed(t):
    """A perceptron a language, averaged over its steps and mixed; tested against a plain loop."""
    x = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").where("quality IS NOT NULL")
    feats = F.array(S("source"), F.concat(F.lit("size"), F.floor(F.log2(S("n_chars") + 1)).cast("string")))
    return learn.perceptron(x.select("lang", "doc_id", F.when(S("quality") > 0, 1).otherwise(-1).alias("y"), feats.alias("feats")), "lang", "doc_id")


@query("""WITH s AS (SELECT sum(1) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q FROM orders), h AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus AS feat FROM lineitem),
g AS (SELECT feat, count(*) AS n1, sum(o_totalprice) AS s1, sum(o_totalprice * o_totalprice) AS q1 FROM h JOIN orders ON o_orderkey = k GROUP BY 1),
b AS (SELECT feat, (q - s * s / n) - (q1 - s1 * s1 / n1) - ((q - q1) - (s - s1) * (s - s1) / (n - n1)) AS gain FROM g, s WHERE n1 < n)
SELECT o_orderkey AS key, CASE WHEN o_orderkey IN (SELECT k FROM h WHERE feat = (SELECT arg_max(feat, gain) FROM b)) THEN 'L' ELSE 'R' END AS cluster FROM orders""")
def best_split(t):
    """One level of splits: the feature that lowers the variance most."""
    rows = t.lineitem.select(S("l_orderkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("feat")).distinct()
    return summarize.divisive(rows, t.orders.select(S("o_orderkey").alias("key"), "o_totalprice"), 1, "o_totalprice").select("key", "cluster")


PREDICATES = f"p AS (SELECT k AS sent, n AS arg, f AS predicate, 'd' || q % 5 AS path, n AS length FROM ({LINES_OF}))"


def predicate_paths(t):
    return lines_of(t).select(S("k").alias("sent"), S("n").alias("arg"), S("f").alias("predicate"), F.concat(F.lit("d"), (S("q") % 5).cast("string")).alias("path"), S("n").alias("length"))


@query(f"""WITH {PREDICATES}, l AS (SELECT path, ln(count(*) / (SELECT count(*) FROM p)) AS lp FROM p GROUP BY 1), x AS (SELECT * FROM p JOIN l USING (path))
SELECT a.sent, a.predicate, a.arg AS a, b.arg AS b, round((a.lp + b.lp) * (a.length + b.length), 6) AS score FROM x a JOIN x b ON a.sent = b.sent AND a.predicate = b.predicate AND a.arg < b.arg""")
def common_predicates(t):
    return extras.common_predicates(predicate_paths(t)).select("sent", "predicate", "a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {PREDICATES} SELECT sent, arg, predicate FROM (SELECT *, row_number() OVER (PARTITION BY sent, arg ORDER BY length, predicate) AS r FROM (SELECT sent, arg % 2 AS arg, predicate, length FROM p)) WHERE r = 1")
def predicate_cover(t):
    """The nearest predicate of every argument."""
    return extras.predicate_cover(predicate_paths(t).withColumn("arg", S("arg") % 2)).select("sent", "arg", "predicate")


@query(f"WITH {PREDICATES} SELECT arg, list_sort(list(DISTINCT predicate)) AS predicates FROM p WHERE arg <= 3 GROUP BY 1")
def predicates_near(t):
    p = predicate_paths(t)
    return retrieval.predicates_near(p.select("arg", "predicate"), t.spark.createDataFrame([(1,), (2,), (3,)], "arg int"))


@query("SELECT n_nationkey AS node FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)")
def knowledge_expansion(t):
    """Search and merge in rounds: from one nation to all of its region."""
    n = t.nation.select(S("n_nationkey").alias("node"), "n_regionkey")
    find = lambda front: front.join(n, "node").select("n_regionkey").distinct().join(n, "n_regionkey").select("node")
    return retrieval.expand(n.where("node = 0").select("node"), find, 3, "node")


@query("SELECT DISTINCT 'c' || c_custkey AS node FROM customer WHERE c_nationkey IN (1, 2) UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey IN (1, 2)")
def one_hop(t):
    """What shares a fact with two nations and was not visited."""
    node = lambda p, c: F.concat(F.lit(p), S(c).cast("string"))
    f = t.customer.select(F.lit("lives").alias("rel"), F.array(node("c", "c_custkey"), node("n", "c_nationkey")).alias("args"))
    f = f.unionByName(t.nation.select(F.lit("in").alias("rel"), F.array(node("n", "n_nationkey"), node("r", "n_regionkey")).alias("args")))
    front = t.spark.createDataFrame([("n1",), ("n2",)], "node string")
    return facts.one_hop(f, front, front)


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS s, l_linenumber + 1 + l_quantity::INT % 3 AS e FROM lineitem) SELECT q.doc, q.s AS q_start, q.e AS q_end, a.s AS "start", a.e AS "end" FROM s q JOIN s a ON q.doc = a.doc AND a.s = q.s AND a.e > q.e""")
def commit_index(t):
    """Longer spans that start where a span starts."""
    s = t.lineitem.selectExpr("l_orderkey AS doc", "l_linenumber AS start", "l_linenumber + 1 + int(l_quantity) % 3 AS end")
    return facts.span_index(s, s, "start").where(S("end") > S("q_end"))


@query("SELECT l_partkey AS mid, list_sort(list(DISTINCT l_returnflag)) AS types FROM lineitem GROUP BY 1")
def entity_types(t):
    return facts.multimap(t.lineitem, "l_partkey", "l_returnflag", distinct=True).select(S("l_partkey").alias("mid"), S("values").alias("types"))


@query("SELECT left(md5(c_mktsegment || c_nationkey), 8) AS uuid, count(*) AS n FROM customer GROUP BY 1")
def by_uuid(t):
    """Mentions indexed by the prefix of their identifier."""
    x = t.customer.select(text.uuid_prefix(F.md5(F.concat("c_mktsegment", S("c_nationkey").cast("string")))).alias("uuid"), "c_custkey")
    return facts.multimap(x, "uuid", "c_custkey").select("uuid", F.size("values").cast("long").alias("n"))


@query("""WITH w AS (SELECT p_brand, p_type AS concept, count(*)::DOUBLE AS weight FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, concept) AS r FROM w) SELECT p_brand, concept, CASE WHEN r <= 3 THEN weight ELSE 0.0 END::DOUBLE AS weight FROM r""")
def top_weights(t):
    w = t.part.groupBy("p_brand", S("p_type").alias("concept")).agg(F.count("*").cast("double").alias("weight"))
    return summarize.top_weights(w, "p_brand", 3).select("p_brand", "concept", "weight")


@query("SELECT arg_max(user_id, (s, -user_id)) AS user_id FROM (SELECT user_id, round(sum(value), 6) AS s FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 50)")
def next_entity(t):
    """The entity of largest weight that is not listed."""
    w = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("s"))
    left = facts.not_known(w, t.events.where("event_id < 50").select("user_id"), key=["user_id"])
    return left.agg(F.max_by("user_id", F.struct("s", -S("user_id"))).alias("user_id"))


# retrieval

@query(f"WITH {F2T}, f AS (SELECT feat, count(*) AS a, count(DISTINCT split_part(tok, '-', 1)) AS b FROM f2t GROUP BY 1) SELECT feat, round(2.0 * a * b / (a + b), 6)::DOUBLE AS f, row_number() OVER (ORDER BY round(2.0 * a * b / (a + b), 6), feat) AS rank FROM f")
def feature_selectivity(t):
    """Features by the harmonic mean of their frequencies, the rarest first."""
    x = retrieval.by_selectivity(retrieval.feature_frequencies(tables(t)["f2t"], F.substring_index("tok", "-", 1)))
    f = F.round("f", 6)
    return x.select("feat", f.alias("f"), F.row_number().over(Window.orderBy(f, "feat")).cast("long").alias("rank"))  # few features


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS r FROM events) SELECT remaining, (max(value) FILTER (WHERE r = 100) + max(value) FILTER (WHERE r = 50)) / 2 > 0.5 * remaining AS stop FROM s, (VALUES (1.0::DOUBLE), (1000000.0)) v(remaining) GROUP BY 1")
def early_stop(t):
    """Whether what is left of a query can still matter."""
    s = t.events.select(S("value").alias("score"))
    return t.spark.createDataFrame([(x, retrieval.early_stop(s, x)) for x in (1.0, 1e6)], "remaining double, stop boolean")


@query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS c, list(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1) SELECT k, round((list_contains(c, 'R')::INT + 2 * list_contains(s, 'O')::INT) / (sqrt(len(c) + 4 * len(s)) * sqrt(2)), 8) AS score FROM a""")
def attribute_cosine(t):
    a = t.lineitem.groupBy(S("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("comm_attrs"), F.collect_set("l_linestatus").alias("tok_attrs"))
    return retrieval.attribute_cosine(a, F.array(F.lit("R"), F.lit("O"))).select("k", r8(S("score"), "score"))


@query(f"{TRIAGE}, x AS (SELECT split_part(tok, '-', 1)::BIGINT AS comm, m, (split_part(tok, '-', 1)::BIGINT % 10) / 10.0 AS s FROM e), y AS (SELECT comm, max(round(s + m + 10 * m * (0.1 + s), 9)) AS score FROM x WHERE s + m + 10 * m * (0.1 + s) >= 1e-4 AND NOT (s < 0.05 AND m < 0.001) GROUP BY 1) SELECT comm, round(score, 5) AS score FROM y ORDER BY y.score DESC, comm LIMIT 25")
def search_service(t):
    """Search as one call: the best 25 documents."""
    service = retrieval.SearchService(tables(t), F.substring_index("tok", "-", 1), 100000)
    sim = t.orders.select(S("o_orderkey").alias("comm"), (S("o_orderkey") % 10 / 10).alias("tfidf"))
    return service.search(query_feats(t), sim, 25).select("comm", F.round("score", 5).alias("score"))


@query(f"""WITH {F2T}, f AS (SELECT feat, 2.0 * greatest(count(*), 3) * greatest(count(DISTINCT split_part(tok, '-', 1)), 3) / (greatest(count(*), 3) + greatest(count(DISTINCT split_part(tok, '-', 1)), 3)) AS f FROM f2t GROUP BY 1) SELECT tok, round(sum(11 / (10 + f)), 7)::DOUBLE AS score FROM f2t JOIN q USING (feat) JOIN f USING (feat) GROUP BY 1""")
def raw_feature_search(t):
    """Features as a query, scored by a prior instead of idf."""
    f2t, q = tables(t)["f2t"], query_feats(t)
    fr = retrieval.feature_frequencies(f2t, F.substring_index("tok", "-", 1), q)
    return retrieval.triage(f2t, q, fr, 100000, mode="prior").select("tok", F.round("ent_match", 7).alias("score"))


@query(f"{TRIAGE} SELECT round(sum(ln(100000) - ln(f)), 6) AS precision FROM q JOIN f USING (feat)".replace("AS precision", 'AS "precision"'))
def triage_precision(t):
    """The summed scores of all of a query's features."""
    fr = retrieval.feature_frequencies(tables(t)["f2t"], F.substring_index("tok", "-", 1), query_feats(t))
    return fr.agg(F.round(F.sum(scores.triage_score(S("tok_freq"), S("doc_freq"), F.lit(100000))), 6).alias("precision"))


@query("""SELECT l_orderkey, arg_min(f, (-n, f)) AS kind FROM (SELECT l_orderkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def mention_types(t):
    """The commonest tag of a span's tokens."""
    return t.lineitem.groupBy("l_orderkey").agg(text.majority(F.collect_list("l_returnflag")).alias("kind"))


@query("""SELECT page_id AS key, round(2.0 ** ((html LIKE '%<img%')::INT + (html LIKE '%href=%')::INT) * page_id, 6)::DOUBLE AS score FROM pages""")
def rescored_slots(t):
    """Scores doubled for every expression that matches."""
    p = t.spark.createDataFrame([("link", "href="), ("image", "<img")], "rel string, pattern string")
    hits = retrieval.slot_matches(t.pages.select(S("page_id").alias("key"), S("html").alias("text")), p)
    return retrieval.rescored(t.pages.select(S("page_id").alias("key"), S("page_id").cast("double").alias("score")), hits, 2.0)


@query("SELECT l_orderkey AS comm, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1")
def tokens_with_documents(t):
    """Mentions joined to their documents through the index."""
    tok = index(t).select("tok").distinct()
    return extras.documents_of_tokens(tok, tables(t)["t2c"]).groupBy("comm").agg(F.count("*").alias("n"))


# state and streams

@query("SELECT n_name AS name FROM nation")
def state_reset(t):
    """What belongs to a document goes, permanent facts stay."""
    perm = t.nation.select(S("n_name").alias("name"), F.lit(True).alias("is_schema"))
    return state.reset(t.customer.select(S("c_name").alias("name"), F.lit(False).alias("is_schema")).unionByName(perm)).select("name")


def stream_input(t):
    """Events as facts of their users, and a line that ends each, as one file."""
    path = scratch_path(t.spark, "stream")
    f = t.events.select(S("user_id").alias("docid"), F.lit("x").alias("cmd")).unionByName(t.events.select(S("user_id").alias("docid"), F.lit("done").alias("cmd")).distinct())
    f.coalesce(1).write.parquet(path)
    return state.stream_of(t.spark, path, f.schema)


@query("SELECT user_id AS docid, count(*) AS consumed FROM events GROUP BY 1")
def annotation_barrier(t):
    """A stream of facts; a document's state is emitted and cleared by the line that ends it."""
    out = scratch_path(t.spark, "barrier")
    state.listen(state.barrier_stream(stream_input(t)), lambda df, _: df.write.mode("append").parquet(out), scratch_path(t.spark, "cp")).awaitTermination()
    return t.spark.read.schema("docid long, consumed long").parquet(out)


@query("SELECT 'x' AS cmd, count(*) AS n FROM events UNION ALL SELECT 'done', count(DISTINCT user_id) FROM events")
def fact_listeners(t):
    """A consumer sees every new fact of a stream once."""
    out = scratch_path(t.spark, "heard")
    state.listen(stream_input(t), lambda df, epoch: df.write.mode("append").parquet(out), scratch_path(t.spark, "cp")).awaitTermination()
    return t.spark.read.schema("docid long, cmd string").parquet(out).groupBy("cmd").agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality = 1 AS right FROM labels".replace("AS right", 'AS "right"'))
def instance_evaluation(t):
    """Gold against gold: every instance is right where it is marked."""
    x = t.labels.where("quality IS NOT NULL")
    m = evaluate.marked(x.select("doc_id", "quality"), x.where("quality = 1").select("doc_id", "quality"), ["doc_id", "quality"])
    return m.select("doc_id", (S("in_pred") == 1).alias("right"))
