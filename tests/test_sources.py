import datetime

import pytest
from pyspark.sql import functions as F

from orrery.sources import sinks
from orrery.sources import text as src


def lines(spark, *values):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, ord long, value string")


def test_fact_lines(spark):
    got = src.fact_lines(lines(spark, "def srl2 <witness-srl1> <x>", "", "# only a note", "x word2 0 John # seen", "startdoc id42")).orderBy("ord").collect()
    assert [(r.cmd, r.rel, r.args) for r in got] == [("def", "srl2", ["<witness-srl1>", "<x>"]), ("x", "word2", ["0", "John"]), ("startdoc", "id42", [])]
    assert got[1].comment == "seen"


def test_many_docs_and_commands(spark):
    f = src.fact_lines(lines(spark, "schema role f1 A", "startdoc a", "x w 0 b", "x w 0 b", "y w 1 c", "startdoc b", "x w 0 d"))
    assert [(r.docid, r.rel, r.args) for r in src.many_docs(f, dedup=True).orderBy("ord").collect()] == [(None, "role", ["f1", "A"]), ("a", "w", ["0", "b"]), ("a", "w", ["1", "c"]), ("b", "w", ["0", "d"])]
    r = src.routed(f)
    assert r["documents"].count() == 2 and r["labels"].count() == 1 and r["schema"].count() == 1
    with pytest.raises(Exception, match="unknown command"):
        src.routed(src.fact_lines(lines(spark, "z a b")))["observed"].collect()


def test_conll(spark):
    got = src.conllx(lines(spark, "1\tJohn\tjohn\tN\tNNP\t_\t2\tsubj\t_\t_", "2\tsings\tsing\tV\tVBZ\t_\t0\troot\t_\t_", "", "", "1\tYes\tyes\tU\tUH\t_\t0\troot\t_\t_")).orderBy("sent", "at").collect()
    assert [(r.sent, r.at, r.form, r.head) for r in got] == [(0, 0, "John", 1), (0, 1, "sings", -1), (1, 0, "Yes", -1)]
    ner = src.conll03(lines(spark, "-DOCSTART- -X- O O", "", "EU NNP B-NP B-ORG", "", "-DOCSTART- -X- O O", "", "Rome NNP B-NP B-LOC")).orderBy("sent").collect()
    assert [(r.doc, r.word, r.ner) for r in ner] == [(1, "EU", "B-ORG"), (2, "Rome", "B-LOC")]


def test_linked_sentences(spark):
    got = src.linked_sentences(lines(spark, "Near [FREEBASE mid=/m/0q7 Quillfen] lake [FREEBASE mid=/m/1 Bob] sat", "broken [FREEBASE mid=/m/1")).collect()
    assert len(got) == 1 and got[0].text == "Near Quillfen lake Bob sat"
    assert [got[0].text[x.start : x.end] for x in got[0].links] == ["Quillfen", "Bob"]


def test_triples(spark):
    got = src.triples(lines(spark, "<http://a> <http://v> <http://b> .", '<http://a> <http://v> "x"@en .', '<http://a> <http://v> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .', "# note")).collect()
    assert [(r.obj, r.kind, r.obj_long) for r in got] == [("http://b", "entity", None), ("x", "string", None), ("7", "integer", 7)]


def test_gigaword(spark):
    g = spark.createDataFrame([("NYT_ENG_20070101.0001",), ("nope",), (None,)], "id string").select(src.gigaword_id(F.col("id")).alias("g")).collect()
    assert (g[0].g.source, g[0].g.date, g[0].g["index"]) == ("NYT", datetime.date(2007, 1, 1), 1)
    assert g[1].g.year is None and g[2].g.year is None


def test_vw_and_features(spark):
    v = src.vw_lines(lines(spark, "1 |a f1 f2 |b f3", "-1 |a x")).orderBy("ord").collect()
    assert v[0].y == 1 and [(n.name, n.feats) for n in v[0].ns] == [("a", ["f1", "f2"]), ("b", ["f3"])]
    f = src.feature_file(lines(spark, "d\t3-4\t5-7\tx\ty\t2:9\t1:4")).first()
    assert (f.target.start, f.arg.end, [(p.t, p.f) for p in f.feats]) == (3, 7, [(2, 9), (1, 4)])
    b = src.bialphabet(lines(spark, "1\t2\tT\tF", "1\t2\tT\tF\t8\t9")).collect()
    assert [(r.oldT, r.oldF) for r in b] == [(-1, -1), (8, 9)]


def test_lines_over_many_splits(spark):
    """Numbers and the last document are carried over the splits of a file."""
    split = 1 << src.SPLIT_BITS
    rows = [("f", 0, "x a 0"), ("f", 1, "startdoc one"), ("f", split, "x a 1"), ("f", 3 * split, "x a 2"), ("f", 3 * split + 1, "startdoc two"), ("f", 4 * split + 5, "x a 3"), ("g", 7 * split, "x b 0"), ("g", 7 * split + 1, "startdoc three"), ("g", 9 * split, "x b 1")]
    f = src.fact_lines(spark.createDataFrame(rows, "file string, ord long, value string"))
    assert [r.provenance for r in f.orderBy("file", "ord").collect()] == [f"line {i} of f" for i in range(1, 7)] + [f"line {i} of g" for i in range(1, 4)]
    assert [(r.docid, r.args) for r in src.many_docs(f).orderBy("file", "ord").collect()] == [(None, ["0"]), ("one", ["1"]), ("one", ["2"]), ("two", ["3"]), (None, ["0"]), ("three", ["1"])]
    lines_ = [("f", 0, "a X O t"), ("f", split, ""), ("f", split + 1, "b X O t"), ("f", 2 * split, "c X O t"), ("f", 3 * split, ""), ("f", 4 * split, "d X O t")]
    got = src.conll03(spark.createDataFrame(lines_, "file string, ord long, value string")).orderBy("sent", "at").collect()
    assert [(r.sent, r["at"], r.word) for r in got] == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "d")]


def test_positional_zips_every_file(spark):
    """Two files in a frame are zipped with the two of the other, not line by line of both."""
    frame = lambda p: spark.createDataFrame([(f"{p}{i}", k, f"{p}{i}.{k}") for i in (1, 2) for k in range(3)], "file string, ord long, value string")
    got = {(r.value_0, r.value_1) for r in src.positional(frame("a"), frame("b")).collect()}
    assert got == {(f"a{i}.{k}", f"b{i}.{k}") for i in (1, 2) for k in range(3)}


def test_propositions_and_archives(spark):
    p = src.proposition_lines(lines(spark, "nw/x.parse 3 4 gold join-v join.01 ----- 0:1*5:0-ARG0 4:0-rel 6:2-ARG1", "too short")).collect()
    assert len(p) == 1 and (p[0].lemma, p[0].sense, p[0].terminal) == ("join", "join.01", 4)
    assert [(a.terminal, a.label) for a in p[0].args] == [(0, "ARG0"), (4, "rel"), (6, "ARG1")]
    got = src.fetched(spark.range(5), "id", lambda: lambda ids: [(i, i * i) for i in ids], "id long, square long", batch=2).collect()
    assert sorted((r.id, r.square) for r in got) == [(i, i * i) for i in range(5)]


def test_positional_raises_on_length(spark):
    a, b = lines(spark, "x", "y"), lines(spark, "1")
    with pytest.raises(Exception, match="shorter"):
        src.positional(a, b).collect()


def test_sinks(spark, tmp_path):
    f = src.fact_lines(lines(spark, "x b 2", "x a 1", "x a 0"))
    assert [r.value for r in sinks.state_dump(f, skip=["b"]).collect()] == ["yhat a 0", "yhat a 1"]
    sinks.write_facts(f, str(tmp_path / "facts"))
    assert src.lines(spark, str(tmp_path / "facts")).count() == 3
    e = spark.createDataFrame([(1, [(3, 70000)]), (2, [])], "id int, feats array<struct<t:int,f:int>>")
    assert sorted((r.id, [tuple(p) for p in r.feats]) for r in sinks.unpacked_features(sinks.binary_features(e)).collect()) == [(1, [(3, 70000)]), (2, [])]
