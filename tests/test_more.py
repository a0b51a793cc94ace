"""Operators that no registered query shows."""

from pyspark.sql import functions as F

from orrery.functions import paths, scores, templates, text
from orrery.operators import decide, evaluate, extras, facts, retrieval, sample, summarize
from orrery.plans.rules import Relation
from orrery.sources import sinks
from orrery.sources import text as src


def test_xml_sources(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<?xml version="1.0"?><frames><frame name="Activity"><FE name="Agent"/><FE name="Place"/></frame><frame name="Motion"><FE name="Theme"/><FE name="Goal"/></frame></frames>')
    got = {r.name: r.roles for r in src.frames_xml(spark, str(tmp_path / "f.xml")).collect()}
    assert got == {"Activity": ["Agent", "Place"], "Motion": ["Theme", "Goal"]}
    (tmp_path / "e.xml").write_text('<root><Document doc_name="d1"><token t_id="1" sentence="0">A</token><token t_id="2" sentence="0">b</token></Document></root>')
    assert [(r.doc, r.token, r.text) for r in extras.ecb_tokens(spark, str(tmp_path / "e.xml")).orderBy("token").collect()] == [("d1", 0, "A"), ("d1", 1, "b")]
    assert src.open_source(spark, f"xml:frame:{tmp_path}/f.xml").count() == 2
    assert src.open_source(spark, f"text:{tmp_path}/f.xml").count() == 1


def test_tables_on_disk(spark, tmp_path):
    d = spark.createDataFrame([("f", 0, "10"), ("f", 1, "a\t3"), ("f", 2, "b\t1"), ("g", 0, "5"), ("g", 1, "a\t2")], "file string, ord long, value string")
    assert {r.term: (r.df, r.n_docs) for r in src.document_frequencies(d).collect()} == {"a": (5, 15), "b": (1, 15)}
    sinks.write_partitions(d, F.when(F.col("file") == "f", "p"), str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3
    for _ in range(2):
        sinks.write_index({"f2t": d}, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix/f2t")).count() == 10
    sinks.write_tsv(d.select("file", "ord"), str(tmp_path / "tsv"))
    v = spark.createDataFrame([(1.0, [("a", ["x", "y"])])], "y double, ns array<struct<name:string,feats:array<string>>>")
    assert sinks.vw_text(v).first().value == "1.0 |a x y"


def test_relations_and_filters(spark):
    assert Relation("srl2", ("a", "b"), ("x", "y")).definition() == "def srl2 <x> <y>"
    f = spark.createDataFrame([("r", ["a", "b"]), ("r", ["b", "c"]), ("s", ["a", "c/C"])], "rel string, args array<string>")
    front = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in facts.one_hop(f, front, front).collect()} == {"b", "c/C"}
    assert facts.only_one(facts.matching(f, "s", 0, "a")).count() == 1
    assert facts.without_role_suffix(f, F.col("args")[1]).count() == 2
    assert {(r.rel, r.k0, r.n) for r in facts.grouped(f, [0]).collect()} == {("r", "a", 1), ("r", "b", 1), ("s", "a", 1)}
    assert facts.same_keys(f, f.limit(3), ["rel"]) and not facts.same_keys(f, f.where("rel = 's'"), ["rel"])
    m = spark.createDataFrame([("x", ["PER"]), ("y", ["O"]), ("z", ["PER", "ORG"]), ("t\tu", ["PER"])], "mention string, types array<string>")
    assert [r.mention for r in extras.entity_mentions(m).collect()] == ["x"]


def test_paths(spark):
    kind = "array<struct<word:string,pos:string,deprel:string,head:int>>"
    toks = [("The", "DT", "det", 1), ("dog", "NN", "nsubjpass", 3), ("was", "VBD", "auxpass", 3), ("seen", "VBN", "root", -1), ("by", "IN", "prep", 3), ("Bob", "NNP", "pobj", 4)]
    d = spark.createDataFrame([(toks,)], f"tokens {kind}")
    t = F.col("tokens")
    r = d.select(
        paths.path_text(t, F.lit(0), F.lit(5)).alias("p"), paths.depths(t).alias("d"), paths.passive(t, F.lit(3)).alias("v"), paths.lacks_subject(t, F.lit(3)).alias("m"), paths.dependents(t, F.lit(3)).alias("k"),
        paths.noun_phrase(t, F.lit(1)).alias("np"), paths.attribute_paths(t, F.lit(1)).alias("a"), paths.argument_spans(t, F.lit(1), "xue_palmer").alias("xp"), paths.argument_spans(t, F.lit(3), "dependency").alias("ds"),
        paths.path_grams(F.array(F.lit("a"), F.lit("b")), 2).alias("g"), text.head_of(F.lit(0), F.lit(2), paths.depths(t)).alias("h")).first()
    assert r.p == "det<nsubjpass<>prep>pobj" and r.d == [2, 1, 1, 0, 1, 2] and r.v and not r.m and r.k == ["auxpass", "nsubjpass", "prep"]
    assert (r.np.start, r.np.end, r.h) == (0, 2, 1) and [(x.path, x.backoff) for x in r.a] == [("nsubjpass<>prep>pobj", "NNP")]
    assert {(x.start, x.end) for x in r.xp} == {(0, 1), (2, 3), (4, 6)} and len(r.ds) == 6 and r.g == ["^ a", "a b", "b $"]


def test_retrieval_steps(spark):
    s = spark.createDataFrame([(i, float(100 - i)) for i in range(60)], "tok int, score double")
    assert retrieval.early_stop(s, 1.0) and not retrieval.early_stop(s, 1e6)
    step = lambda f: f.select((F.col("n") + 1).alias("n")).where("n < 5")
    assert {r.n for r in retrieval.expand(spark.createDataFrame([(1,)], "n int"), step, 10, "n").collect()} == {1, 2, 3, 4}
    m = spark.createDataFrame([("d", 0, 10), ("d", 0, 40)], "doc string, start int, end int")
    q = spark.createDataFrame([("d", 2, 5)], "doc string, begin int, finish int")
    assert facts.resolved_mentions(q, m).first().end == 10
    x = spark.createDataFrame([(["a", "b", "c"], [3.0, None, 9.0], ["/m/1", "/m/2"])], "w array<string>, idf array<double>, mids array<string>")
    assert x.select(text.sentence_key(F.col("w"), F.col("idf"), F.col("mids"), 1).alias("k")).first().k == "/m/1_/m/2#c"
    w = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "key string, score double")
    n = spark.createDataFrame([("a",), ("a",)], "key string")
    assert {r.key: r.score for r in retrieval.rescored(w, n, 0.5).collect()} == {"a": 0.5, "b": 1.0}


def test_scores_and_samples(spark):
    d = spark.range(1)
    assert d.select(scores.expected_loss_choice(F.array(F.lit(0.4), F.lit(0.35), F.lit(0.25)), 1.0, 3.0).alias("i")).first().i == 1
    assert d.select(scores.largest_only(F.array(F.lit(1.0), F.lit(2.0))).alias("x")).first().x == [float("-inf"), 0.0]
    assert scores.split_budget(70, 3, 2.0) == [10, 20, 40]
    assert sample.random_products(spark.createDataFrame([(c,) for c in "abcdef"], "t string"), "t", 3.0, 50).groupBy("set").count().agg(F.avg("count")).first()[0] > 2
    assert sample.sampled_pairs(spark.range(100).withColumn("l", F.lit("x")), "l", {"x": 1.0}, F.col("id")).count() == 100
    assert sample.by_table(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "dev")], "k string, section string"), "k").where("section = 'train'").count() == 1
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert evaluate.zipped(a, a, "id").count() == 2
    n, pairs = decide.global_features(spark.createDataFrame([("t", "A0"), ("t", "A1")], "t string, role string"), ["t"], "role")
    assert n.first().n_args == 2 and pairs.first().role_b == "A1"
    r = d.select(decide.name_rank(F.lit("ARG0")).alias("a"), decide.name_rank(F.lit("ARG1")).alias("b")).first()
    assert r.a > r.b


def test_classifier_templates_summary(spark):
    rows = [(i, "g" if i % 2 else "b", x) for i in range(20) for x in (["good", "fine"] if i % 2 else ["bad", "poor"])]
    prior, ll = extras.naive_bayes(spark.createDataFrame(rows, "inst int, y string, x string"))
    assert {r.inst: r.y for r in extras.classified(spark.createDataFrame([(1, "fine"), (2, "poor")], "inst int, x string"), prior, ll).collect()} == {1: "g", 2: "b"}
    alph = templates.alphabet(spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "template string, x string"))
    got = templates.indexed(spark.createDataFrame([("t", "b"), ("t", "z")], "template string, x string"), alph).collect()
    assert sorted((r.t, r.f) for r in got) == [(-1, -1), (0, 1)]
    s = spark.createDataFrame([("e", 0, 3, ["NN", "VB"]), ("e", 1, 3, ["VB", "NN"]), ("e", 2, 3, ["NN"])], "e string, sent int, length int, tags array<string>")
    i = spark.createDataFrame([("e", k, c, 1.0) for k, c in ((0, "x"), (0, "y"), (1, "z"), (2, "z"))], "e string, sent int, concept string, weight double")
    assert [r.sent for r in summarize.summaries(s, i, "e", 10).collect()] == [0]
    assert summarize.mention_costs(i, 2.0).agg(F.max("weight")).first()[0] == 0
    assert [r.value for r in extras.piped(spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1), ["tr", "a-z", "A-Z"]).collect()] == ["A", "B"]


def test_sentences_hold_all_words(spark):
    from types import SimpleNamespace

    from orrery.functions import paths
    from orrery.plans.q_features import sentences

    turns = [(1, 1, "bot", "so it is"), (1, 0, "user", "Is it so"), (2, 0, "user", "Yes")]
    got = {r.conv_id: r for r in sentences(SimpleNamespace(conversations=spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))).collect()}
    assert [(t.word, t.lemma, t.pos, t.head) for t in got[1].tokens] == [("Is", "is", "user", -1), ("it", "it", "user", 0), ("so", "so", "user", 1), ("so", "so", "bot", 2), ("it", "it", "bot", 3), ("is", "is", "bot", 4)]
    assert tuple(got[1].arg) == (5, 6) and [t.word for t in got[2].tokens] == ["Yes"]
    trees = [(0, [-1, 0, 1, 1, 0, 7]), (1, [1, 2, 0, 1, -1, 4]), (2, [-1])]
    df = spark.createDataFrame([(i, [(h,) for h in heads]) for i, heads in trees], "i int, tokens array<struct<head:int>>")
    r = {x.i: x for x in df.select("i", paths.depths(F.col("tokens")).alias("d"), F.transform("tokens", lambda _, i: F.size(paths.chain(F.col("tokens"), i)) - 1).alias("c"), paths.subtree(F.col("tokens"), F.lit(0)).alias("s")).collect()}
    assert all(x.d == x.c for x in r.values())
    assert [tuple(r[i].s) for i in range(3)] == [(0, 5), (0, 4), (0, 1)]
