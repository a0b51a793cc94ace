"""Queries of the fact and rule engine, decisions, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, evaluate, facts, sample
from .fixpoint import backward, closure, k_hop, random_walk, shortest_hops
from .registry import Tables, query
from .rules import Program


def shop(t: Tables) -> Program:
    p = Program()
    p.relation("order_by", ["c", "o"], t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")))
    p.relation("item", ["o", "p", "q"], t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")))
    p.relation("brand", ["p", "b"], t.part.select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("b")))
    p.relation("bought", ["c", "b"])
    return p


@query("SELECT DISTINCT o_custkey AS c, p_brand AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def rule_bought(t):
    return shop(t).rule("order_by(c, o) & item(o, p, q) & brand(p, b) => bought(c, b)").derive("bought")


@query("""SELECT DISTINCT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size""")
def rule_self_join(t):
    p = Program().relation("part", ["k", "b", "ty", "s"], t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.col("p_type").alias("ty"), F.col("p_size").alias("s")))
    p.relation("alike", ["x", "y"])
    return p.rule("part(x, b, ty, s) & part(y, b, ty, s) => alike(x, y)").derive("alike")


@query("SELECT DISTINCT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def rule_constant(t):
    p = Program().relation("nation", ["n", "r"], t.nation.select(F.col("n_name").alias("n"), F.col("n_regionkey").alias("r")))
    p.relation("region", ["r", "name"], t.region.select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name"))).relation("asian", ["n"])
    return p.rule("nation(n, r) & region(r, 'ASIA') => asian(n)").derive("asian")


@query("SELECT DISTINCT r_name AS r, n_name AS n FROM region, nation")
def rule_free_relation(t):
    """Terms without a shared variable multiply, as the language defines (5 by 25 rows here)."""
    p = Program().relation("region", ["r"], t.region.select(F.col("r_name").alias("r"))).relation("nation", ["n"], t.nation.select(F.col("n_name").alias("n"))).relation("pair", ["r", "n"])
    return p.rule("region(r) & nation(n) => pair(r, n)").derive("pair")


@query("SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def rule_witness(t):
    """Facts as arguments: two people are tied through the fact that names their nation."""
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("n"))
    p = Program().relation("nation", ["k", "n"], n)
    p.relation("cust", ["c", "k"], t.customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("k")))
    p.relation("supp", ["s", "k"], t.supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("long").alias("k")))
    p.relation("in_c", ["c", "w"]).relation("in_s", ["s", "w"]).relation("pair", ["c", "s"])
    p.rule("cust(c, k) & nation'(w, k, n) => in_c(c, w)\nsupp(s, k) & nation'(w, k, n) => in_s(s, w)")
    for r in ("in_c", "in_s"):
        p.facts[r] = p.derive(r)
    return p.rule("in_c(c, w) & in_s(s, w) => pair(c, s)").derive("pair", by_class=True)


PLACES = """SELECT 'c' || c_custkey AS x, 'n' || c_nationkey AS y FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


@query(f"""WITH RECURSIVE e AS ({PLACES}), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, y FROM r""")
def fixpoint_closure(t):
    """What lies in what: people in nations, nations in regions."""
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("x"), F.concat(F.lit(b), y).alias("y"))
    e = edge(t.customer, "c", "c_custkey", "n", "c_nationkey").union(edge(t.supplier, "s", "s_suppkey", "n", "s_nationkey")).union(edge(t.nation, "n", "n_nationkey", "r", "n_regionkey")).distinct()
    p = Program().relation("edge", ["x", "y"], e).relation("path", ["x", "y"]).rule("edge(x, y) => path(x, y)\npath(x, z) & edge(z, y) => path(x, y)")
    return closure(p)["path"]


@query("SELECT DISTINCT p_partkey AS p, p_brand AS b FROM part")
def backward_expansion(t):
    p = Program().relation("brand", ["p", "b"], t.part.select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("b"))).relation("known", ["p", "b"]).relation("listed", ["p", "b"])
    p.rule("brand(p, b) => known(p, b)\nknown(p, b) => listed(p, b)")
    return backward(p, {"listed": p.facts["brand"].distinct()}, ignore=())["brand"]


EDGES = "SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"


def small_graph(t):
    """Which nation buys from which."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return o.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({EDGES}), r(s, d, h, p) AS (SELECT src, dst, 1, [src, dst] FROM e WHERE src <> dst
UNION ALL SELECT r.s, e.dst, h + 1, list_append(p, e.dst) FROM r JOIN e ON r.d = e.src WHERE h < 2 AND NOT list_contains(p, e.dst) AND e.src <> e.dst)
SELECT s AS start, d AS "end", h::INT AS hops, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def graph_k_hop(t):
    return k_hop(small_graph(t), 2).groupBy("start", "end", "hops").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), r(n, h) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, h + 1 FROM r JOIN e ON r.n = e.src WHERE h < 50)
SELECT 3::BIGINT AS start, n AS node, min(h)::INT AS hops FROM r GROUP BY n""")
def graph_shortest(t):
    return shortest_hops(small_graph(t), t.spark.createDataFrame([(3,)], "node long"), most=50)


@query(f"""WITH e AS ({EDGES}), p AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM e),
m0 AS (SELECT 3::BIGINT AS node, 1.0::DOUBLE AS mass),
s1 AS (SELECT dst AS node, 0.85 * mass * p AS mass FROM m0 JOIN p ON node = src UNION ALL SELECT 3, 0.15 + 0.85 * coalesce((SELECT sum(mass) FROM m0 WHERE node NOT IN (SELECT src FROM e)), 0)),
m1 AS (SELECT node, sum(mass) AS mass FROM s1 GROUP BY node),
s2 AS (SELECT dst AS node, 0.85 * mass * p AS mass FROM m1 JOIN p ON node = src UNION ALL SELECT 3, 0.15 + 0.85 * coalesce((SELECT sum(mass) FROM m1 WHERE node NOT IN (SELECT src FROM e)), 0))
SELECT node, round(sum(mass), 8) AS mass FROM s2 GROUP BY node""")
def graph_random_walk(t):
    return random_walk(small_graph(t), 3, restart=0.15, rounds=2).select("node", F.round("mass", 8).alias("mass"))


TRADE = """SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_quantity > 48 UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_quantity > 48"""


def trade_graph(t):
    """Suppliers to parts, and through large lines parts to orders and orders to suppliers; it has cycles and hubs."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    big = t.lineitem.where("l_quantity > 48")
    e = t.lineitem.select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst"))
    return e.union(big.select(node("p", "l_partkey"), node("o", "l_orderkey"))).union(big.select(node("o", "l_orderkey"), node("s", "l_suppkey"))).distinct()


@query(f"""WITH RECURSIVE e AS ({TRADE}), r(n, h) AS (SELECT 's1', 0 UNION SELECT e.dst, h + 1 FROM r JOIN e ON r.n = e.src WHERE h < 9) SELECT 's1' AS start, n AS node, min(h)::INT AS hops FROM r GROUP BY n""")
def graph_reach(t):
    """Breadth-first rounds from one supplier, nine hops far."""
    return shortest_hops(trade_graph(t), t.spark.createDataFrame([("s1",)], "node string"), most=9)


def order_facts(t):
    """Orders, brands and nations as generic facts."""
    a = t.orders.select(F.lit("order_by").alias("rel"), F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("args"))
    return a.unionByName(t.part.select(F.lit("brand").alias("rel"), F.array(F.col("p_partkey").cast("string"), "p_brand").alias("args")))


@query("SELECT 'brand' AS rel, p_partkey::VARCHAR AS p FROM part WHERE p_brand = 'Brand#13'")
def fact_lookup(t):
    return facts.matching(order_facts(t), "brand", 1, "Brand#13").select("rel", F.col("args")[0].alias("p"))


@query("SELECT o_custkey::VARCHAR AS node, count(*) AS n FROM orders GROUP BY 1")
def fact_neighbours(t):
    a = facts.adjacency(order_facts(t)).where("rel = 'order_by' AND at = 0")
    return a.groupBy("node").agg(F.count("*").alias("n"))


@query("""SELECT 'orders' AS rel, count(*) AS n FROM orders""")
def fact_include(t):
    kept = facts.renamed(facts.kept_relations(order_facts(t), include=["order_by"]), {"order_by": "orders"})
    return kept.groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def document_semi_filter(t):
    e = t.events.select(F.col("user_id").alias("docid"), F.col("event_type").alias("rel"), "event_id")
    return facts.documents_with(e, ["purchase"]).select(F.col("docid").alias("user_id"), "event_id")


POP = "(PARTITION BY user_id ORDER BY value DESC, event_id)"


def scored(t):
    return t.events.select("user_id", "event_id", "event_type", "value", (F.col("value") - 50).alias("score"))


def decided(mode: str, sql: str):
    @query(f"SELECT event_id, {sql} AS accepted FROM (SELECT *, value - 50 AS score FROM events)", name=f"decide_{mode.lower()}")
    def run(t):
        return scored(t).select("event_id", decide.MODES[mode](["user_id"], "value", "score", ["event_id"]).alias("accepted"))


decided("AT_LEAST_ONE", f"row_number() OVER {POP} = 1 OR score > 0")
decided("AT_MOST_ONE", f"score > 0 AND row_number() OVER (PARTITION BY user_id, score > 0 ORDER BY value DESC, event_id) = 1")
decided("EXACTLY_ONE", f"row_number() OVER {POP} = 1")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN value > 50 WHEN 'view' THEN value > 80 ELSE row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 END AS accepted FROM events""")
def decide_by_relation(t):
    one = decide.exactly_one(["user_id"], "value", "score", ["event_id"])
    d = decide.by_relation("event_type", {"click": decide.threshold("value", 50), "view": decide.threshold("value", 80)}, one)
    return scored(t).select("event_id", d.alias("accepted"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN value > 50 END, value > 90) AS accepted FROM events""")
def decide_cascade(t):
    return scored(t).select("event_id", decide.cascade(F.when(F.col("event_type") == "click", F.col("value") > 50), F.col("value") > 90).alias("accepted"))


@query("SELECT event_id, value > 50 AS accepted FROM events")
def decide_unanimous(t):
    return scored(t).select("event_id", decide.unanimous(F.when(F.col("event_type") == "click", F.col("value") > 50), F.col("score") > 0).alias("accepted"))


@query()
def agenda_inference(t):
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("doc"), "event_id", "user_id", "value")
    return decide.agenda_inference(e, "doc", "event_id", "value", "user_id", 25.0, 50.0)


@query(f"""SELECT event_id, round(value, 6) AS value, round(p, 6) AS previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value > p""")
def score_order_check(t):
    return decide.out_of_order(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("value", 6).alias("value"), F.round("previous", 6).alias("previous"))


@query(f"""SELECT event_id, tp::BIGINT AS tp, (step - tp)::BIGINT AS fp, step, round(tp / step, 6) AS "precision", round(CASE WHEN total > 0 THEN tp / total ELSE 1 END, 6) AS recall FROM
(SELECT event_id, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS step, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS total FROM events)""")
def running_quality(t):
    e = t.events.withColumn("gold", F.col("event_type") == "purchase")
    out = decide.running_quality(e, ["user_id"], "value", "gold", ["event_id"])
    return out.select("event_id", "tp", "fp", "step", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT event_id FROM (SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER (PARTITION BY user_id) AS b FROM events WHERE value > 0) WHERE b < 0.75""")
def mass_prefix(t):
    return decide.mass_prefix(t.events.where("value > 0"), ["user_id"], "value", 0.75, ["event_id"]).select("event_id")


@query("""SELECT event_id, lt, gt, n, round(n / (n + 64.0) * n / (least(lt, gt) + 0.01 * n), 6) AS cost FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY round(value)) AS lt, count(*) OVER (PARTITION BY event_type ORDER BY round(value) DESC) AS gt, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def oddness(t):
    from ..functions.scores import oddness as cost

    out = decide.two_sided(t.events.withColumn("v", F.round("value")), ["event_type"], "v")
    return out.select("event_id", "lt", "gt", "n", F.round(cost(F.col("lt"), F.col("gt"), F.col("n")), 6).alias("cost"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(var_pop(value) OVER w, 6) AS variance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def recency_queue(t):
    return decide.recent(t.events, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("""SELECT conv_id, i, j FROM (SELECT conv_id, turn AS i, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM conversations) WHERE j IS NOT NULL""")
def succession(t):
    return facts.succession(t.conversations, "conv_id", "turn")


@query("""SELECT event_id, round(0.5 * tanh((value - 50) / 100) + (CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END), 8) AS priority FROM events""")
def priority_sum(t):
    from ..functions.scores import easy_first

    named = {"easyfirst": easy_first(F.col("score")), "dfs": decide.stage_rank("event_type", {"click": 2.0, "view": 1.0})}
    return scored(t).select("event_id", F.round(decide.weighted("0.5*easyfirst+1*dfs", named), 8).alias("priority"))


@query("""SELECT l_orderkey, l_linenumber, (0 - l_partkey - floor(l_quantity / 1000))::DOUBLE AS arg4target, (0 - l_suppkey - floor(l_quantity / 1000))::DOUBLE AS end_width, -greatest(l_partkey, l_suppkey) / 5 AS leftright FROM lineitem""")
def priority_positions(t):
    p, s, w = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", decide.start_then_width(p, w).cast("double").alias("arg4target"), decide.end_then_width(s, w).cast("double").alias("end_width"), decide.left_right([p, s]).alias("leftright"))


@query("""SELECT s_suppkey, round((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / count(*) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier""")
def priority_row_share(t):
    return t.supplier.select("s_suppkey", F.round(decide.row_share(["s_nationkey"], ["s_suppkey"]), 8).alias("share"))


@query("SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def beam(t):
    return decide.beam(t.events, ["user_id"], "value", 3, ["event_id"]).select("event_id", F.col("rank").cast("long").alias("rank"))


PR = "round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS p, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS r"
MARKED = """g AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE quality = 1), h AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE n_chars > 800),
m AS (SELECT coalesce(g.lang, h.lang) AS lang, g.doc_id IS NOT NULL AS ing, h.doc_id IS NOT NULL AS inp FROM g FULL JOIN h ON g.doc_id = h.doc_id AND g.lang = h.lang)"""


def gold_and_pred(t):
    x = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return x.where("quality = 1").select("doc_id", "lang"), x.where("n_chars > 800").select("doc_id", "lang")


@query(f"""WITH {MARKED}, c AS (SELECT lang, count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE inp AND NOT ing) AS fp, count(*) FILTER (WHERE ing AND NOT inp) AS fn FROM m GROUP BY lang) SELECT lang, tp, fp, fn, {PR} FROM c""")
def quality_by_key(t):
    g, p = gold_and_pred(t)
    return evaluate.quality(g, p, ["doc_id", "lang"], ["lang"]).select("lang", "tp", "fp", "fn", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


@query(f"""WITH {MARKED}, c AS (SELECT count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE inp AND NOT ing) AS fp, count(*) FILTER (WHERE ing AND NOT inp) AS fn FROM m) SELECT tp, fp, fn, {PR} FROM c""")
def quality_micro(t):
    g, p = gold_and_pred(t)
    return evaluate.quality(g, p, ["doc_id", "lang"], []).select("tp", "fp", "fn", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


@query(f"""WITH {MARKED}, c AS (SELECT lang, count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE inp AND NOT ing) AS fp, count(*) FILTER (WHERE ing AND NOT inp) AS fn FROM m GROUP BY lang),
d AS (SELECT CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM c) SELECT round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r FROM d""")
def quality_macro(t):
    g, p = gold_and_pred(t)
    return evaluate.macro(g, p, ["doc_id", "lang"], ["lang"]).select(F.round("macro_p", 6).alias("macro_p"), F.round("macro_r", 6).alias("macro_r"))


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 800)")
def false_negatives(t):
    g, p = gold_and_pred(t)
    return evaluate.missed(g, p, ["doc_id"]).select("doc_id")


@query("""WITH s AS (SELECT l_orderkey AS k, l_partkey % 10 AS gs, l_partkey % 10 + 1 + l_quantity::INT % 5 AS ge, l_suppkey % 10 AS hs, l_suppkey % 10 + 1 + l_linenumber % 4 AS he FROM lineitem)
SELECT round(sum((gs = hs AND ge = he)::INT), 4)::DOUBLE AS exact, round(sum(2.0 * greatest(0, least(ge, he) - greatest(gs, hs)) / (ge - gs + he - hs)), 3) AS f1, sum((gs <= he - 1 AND he - 1 < ge)::INT)::DOUBLE AS extract_head, sum((gs <= hs AND hs < ge AND he - hs = 1)::INT)::DOUBLE AS expect_head FROM s""")
def generous_spans(t):
    s = t.lineitem.selectExpr("l_partkey % 10 AS g_start", "l_partkey % 10 + 1 + int(l_quantity) % 5 AS g_end", "l_suppkey % 10 AS h_start", "l_suppkey % 10 + 1 + l_linenumber % 4 AS h_end").withColumn("h_head", F.col("h_end") - 1)
    credit = {m: evaluate.generous(s, m) for m in ("exact", "f1", "extract_head", "expect_head")}
    return s.agg(*[F.round(F.sum(c), 3).alias(m) for m, c in credit.items()])


@query("""SELECT event_id, round(best, 6) AS best, improved FROM (SELECT event_id, max(value) OVER w AS best, value = max(value) OVER w AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def best_so_far(t):
    return evaluate.best_so_far(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("best", 6).alias("best"), "improved")


@query("""WITH b AS (SELECT round(value) AS t, sum((event_type = 'purchase')::INT) AS pos, count(*) AS n FROM events GROUP BY 1), r AS (SELECT t, sum(pos) OVER w AS tp, sum(n) OVER w AS taken, sum(pos) OVER () AS total FROM b WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))
SELECT t, tp::BIGINT AS tp, taken::BIGINT AS taken, round(2 * tp / (taken + total), 8) AS f1 FROM r ORDER BY 2 * tp / (taken + total) DESC, t DESC LIMIT 1""")
def threshold_search(t):
    e = t.events.withColumn("s", F.round("value")).withColumn("gold", F.col("event_type") == "purchase")
    return evaluate.best_threshold(e, "s", "gold").select("t", "tp", "taken", F.round("f1", 8).alias("f1"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY lang, source) - 1 AS others FROM documents")
def leave_one_out(t):
    return evaluate.leave_one_out(t.documents, ["lang", "source"]).select("doc_id", "others")


@query("""WITH g AS (SELECT l_partkey % 7 AS a, l_suppkey % 7 AS b, l_orderkey % 7 AS c FROM lineitem), p AS (SELECT a AS w, b AS l FROM g UNION ALL SELECT a, c FROM g UNION ALL SELECT b, c FROM g), s AS (SELECT w AS system, 1 AS won FROM p UNION ALL SELECT l, 0 FROM p)
SELECT system, sum(won)::BIGINT AS wins, count(*) AS games, round(sum(won) / count(*), 6) AS rate FROM s GROUP BY system""")
def pairwise_ranks(t):
    j = t.lineitem.selectExpr("l_partkey % 7 AS best", "l_suppkey % 7 AS middle", "l_orderkey % 7 AS worst")
    return evaluate.win_rates(j).withColumn("rate", F.round("rate", 6))


@query("""WITH a AS (SELECT DISTINCT p_size AS k FROM part WHERE p_partkey % 40 = 3), b AS (SELECT DISTINCT p_size AS k FROM part WHERE p_partkey % 40 = 7) SELECT k, 'key' AS what, '-' AS sign FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'key', '+' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_diff(t):
    """Sizes that only one of two groups of parts has."""
    side = lambda r: t.part.where(F.col("p_partkey") % 40 == r).select(F.col("p_size").alias("k")).distinct()
    return facts.diff(side(3), side(7)).withColumn("what", F.lit("key")).select("k", "what", "sign")


@query("SELECT DISTINCT lang, source FROM documents UNION SELECT DISTINCT lang, source FROM documents")
def union_documents(t):
    d = t.documents.select("lang", "source").withColumn("rel", F.lit("x"))
    return facts.union_documents(d, d, doc="source").select("lang", "source")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def state_insert(t):
    d = t.documents.select("doc_id", "text")
    return facts.insert(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"]).join(d.groupBy("text").agg(F.min("doc_id").alias("m")), "text").select(F.col("m").alias("doc_id"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def agenda_dedup(t):
    """Parts that are neither pending nor accepted."""
    side = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("p_partkey"))
    return facts.not_known(t.part.select("p_partkey"), side("l_quantity > 45"), side("l_discount > 0.09"), key=["p_partkey"])


@query("SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def key_violations(t):
    return facts.violations(t.part, ["p_brand"], "p_type")


@query("""SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events)) GROUP BY 1, 2, 3""")
def adjacent_runs(t):
    return facts.runs(t.events, ["ts", "event_id"], "event_type", ["user_id"])


@query("SELECT * FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE l_partkey IN (SELECT l_partkey FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 25 AND sum(n) >= 28)")
def matrix_row_prune(t):
    e = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return facts.dense_rows(e, "l_partkey", "l_suppkey", "n", 1, 25, 28).select("l_partkey", "l_suppkey", "n")


def core_sql(rounds: int) -> str:
    """Rows, then columns, with fewer than 20 entries dropped so many times; the query goes on until nothing changes."""
    out = "WITH e0 AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
    for i in range(rounds):
        out += f", r{i} AS (SELECT * FROM e{i} WHERE l_partkey IN (SELECT l_partkey FROM e{i} GROUP BY 1 HAVING count(*) >= 20)), e{i + 1} AS (SELECT * FROM r{i} WHERE l_suppkey IN (SELECT l_suppkey FROM r{i} GROUP BY 1 HAVING count(*) >= 20))"
    return f"{out} SELECT l_partkey, l_suppkey FROM e{rounds}"


@query(core_sql(6))
def matrix_core(t):
    return facts.dense_core(t.lineitem.select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey", 20)


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 12)")
def min_observations(t):
    return facts.frequent(t.events, "user_id", 12).select("event_id")


@query("""SELECT a.conv_id, a.turn AS i, b.turn AS j FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.turn - a.turn <= 3""")
def mention_pairs(t):
    return facts.mention_pairs(t.conversations.select("conv_id", "turn"), "conv_id", "turn", 3)


@query("""WITH m AS (SELECT doc_id AS doc, 100 * u AS s, 100 * u + 100 + 50 * v AS e FROM documents, range(0, 3) a(u), range(0, 2) b(v)), q AS (SELECT doc_id AS doc, 110 AS b, 140 AS f FROM documents),
h AS (SELECT q.doc, s, e, row_number() OVER (PARTITION BY q.doc ORDER BY e - s, s) AS n FROM q JOIN m ON q.doc = m.doc AND s <= b AND f <= e) SELECT doc, s AS "start", e AS "end" FROM h WHERE n = 1""")
def mention_resolution(t):
    m = t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("u")).select("doc", "u", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("v"))
    m = m.select("doc", (F.col("u") * 100).cast("long").alias("start"), (F.col("u") * 100 + 100 + F.col("v") * 50).cast("long").alias("end"))
    q = t.documents.select(F.col("doc_id").alias("doc"), F.lit(110).alias("begin"), F.lit(140).alias("finish"))
    return facts.resolved_mentions(q, m).select("doc", "start", "end")


@query("""SELECT o_orderkey AS k, coalesce(min(l_linenumber), -1)::INT AS start FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1""")
def null_spans(t):
    filled = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("start")).withColumn("end", F.col("start") + 1)
    return facts.with_null_spans(t.orders.select(F.col("o_orderkey").alias("k")), filled, ["k"]).select("k", "start")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN source = 'src3' THEN 'dev' ELSE 'train' END AS section FROM documents")
def split_by_lists(t):
    return t.documents.select("doc_id", sample.by_lists(F.col("source"), ["src1", "src2"], ["src3"]).alias("section"))


@query("SELECT doc_id, floor(row_number() OVER (PARTITION BY lang ORDER BY doc_id) / 10)::INT AS block FROM documents")
def split_in_blocks(t):
    return sample.in_blocks(t.documents, ["lang"], ["doc_id"], 10).select("doc_id", "block")


@query("""WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT *, floor(ln(n) / ln(2) + 1e-9)::INT AS bucket FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY (user_id * 7919 + 104729) % 1000003 / 1000003.0, user_id) AS pos FROM b)
SELECT user_id, bucket, CASE WHEN pos <= 5 THEN 'test' WHEN pos <= 10 THEN 'dev' ELSE 'train' END AS section FROM r""")
def split_stratified(t):
    f = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return sample.stratified(f, "n", F.struct(sample.arithmetic_unit(F.col("user_id")), "user_id"), 5, 5).select("user_id", "bucket", "section")


@query()
def document_shuffle(t):
    return sample.shuffled(t.conversations.select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT r_name, n_name FROM region, nation")
def config_grid(t):
    return sample.grid(a=t.region.select("r_name"), b=t.nation.select("n_name")).drop("job")


@query("SELECT role, count(*) AS n_turns FROM conversations GROUP BY role")
def label_bucketing(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n_turns"))
