import random

import pytest

from orrery.plans import rules as rules_module
from orrery.plans.fixpoint import backward, closure
from orrery.plans.rules import Program, infer_types, join_orders, parse_rule, parse_rules, type_graph_dot


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parse_and_print():
    r = parse_rule("parcel'(p, van, town) & rate(town, c) => billed(p, town, c)")
    assert r.body[0].witness == "p" and r.body[0].args == ("van", "town")
    assert parse_rule(str(r)) == r
    assert [o[0] for o in join_orders(r)] == [0, 1]
    with pytest.raises(ValueError):
        parse_rule("a(x) => b(y)")
    with pytest.raises(ValueError):
        parse_rule("a(x)")


def test_a_fact_as_an_argument_meets_every_rate(spark):
    p = Program()
    p.relation("parcel", ["van", "town"], spark.createDataFrame([("v1", "Ulm"), ("v2", "Ulm"), ("v2", "Bonn")], "van string, town string"))
    p.relation("rate", ["town", "class"], spark.createDataFrame([("Ulm", f"c{i}") for i in range(3)] + [("Kiel", "c9")], "town string, class string"))
    p.relation("billed", ["parcel", "class"])
    out = p.rule("parcel'(w, v, t) & rate(t, c) => billed(w, c)").derive("billed")
    assert out.count() == 6 and out.select("parcel").distinct().count() == 2


def test_repeated_variable_and_constant(spark):
    p = Program().relation("r", ["a", "b"], spark.createDataFrame([(1, 1), (1, 2), (2, 2), (None, None)], "a int, b int")).relation("same", ["a"]).relation("one", ["b"])
    assert rows(p.rule("r(x, x) => same(x)").derive("same")) == [(1,), (2,)]
    assert rows(p.rule("r(1, y) => one(y)").derive("one")) == [(1,), (2,)]


def test_closure_against_brute_force(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 5)]
    p = Program().relation("e", ["x", "y"], spark.createDataFrame(edges, "x int, y int")).relation("p", ["x", "y"])
    p.rule("e(x, y) => p(x, y)\np(x, z) & e(z, y) => p(x, y)  # a step more")
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in edges if b == c} - want
        if not more:
            break
        want |= more
    assert set(rows(closure(p)["p"])) == want


def test_backward(spark):
    p = Program().relation("a", ["x"]).relation("b", ["x"]).relation("c", ["x"]).rule("a(x) => b(x)\nb(x) => c(x)")
    got = backward(p, {"c": spark.createDataFrame([(1,)], "x int")})
    assert rows(got["a"]) == [(1,)]


def test_types():
    rules = parse_rules("seat(i, p) & guest(i, w) => known(w)\nknown'(k, w) => seen(k)")
    t = infer_types(rules, {"seat": ("tok", "tag"), "guest": (None, "string")})
    assert t["guest"] == ("tok", "string") and t["seen"] == ("witness-known",)
    assert "witness-known" in type_graph_dot(t)
    with pytest.raises(ValueError):
        infer_types(rules, {"seat": ("tok", "tag")})
    with pytest.raises(ValueError):
        infer_types(parse_rules("a(x) & b(x) => c(x)"), {"a": ("t",), "b": ("u",)})


def test_products_by_class_need_no_distinct(spark, monkeypatch):
    """Pairs through a dropped variable: as by the plain plan, in blocks, with nothing left to make distinct above the pairs."""
    monkeypatch.setattr(rules_module, "BLOCK_MEMBERS", 3)
    rng = random.Random(4)
    some = lambda n, most: rng.choice([None, *range(n)]) if rng.random() < 0.1 else rng.randrange(most)
    a = [(some(30, 30), some(3, 6), rng.randrange(2)) for _ in range(90)]
    b = [(some(30, 20), some(3, 6), rng.randrange(2)) for _ in range(60)]
    p = Program().relation("a", ["x", "w", "k"], spark.createDataFrame(a, "x int, w int, k int")).relation("b", ["y", "w", "k"], spark.createDataFrame(b, "y int, w int, k int"))
    p.relation("c", ["x", "y"]).relation("d", ["x", "k", "y"]).rule("a(x, w, k) & b(y, w, k) => c(x, y)\na(x, w, k) & b(y, w, k) => d(x, k, y)")
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    for name in ("c", "d"):
        got, want = (sorted(map(tuple, p.derive(name, by_class=way).collect()), key=key) for way in (True, False))
        assert got == want and len(set(got)) == len(got)
        plan = p.derive(name, by_class=True)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]


def test_witness_pairs_are_not_shuffled(spark):
    from orrery.plans.queries import QUERIES

    plan = QUERIES["rule_witness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
