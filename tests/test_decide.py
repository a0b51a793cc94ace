import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import decide


class Naive:
    def __init__(self):
        self.d = {}

    def pop(self):
        k = min(self.d, key=lambda k: (-self.d[k], k))
        return k, self.d.pop(k)


def test_agenda_against_naive():
    rng = random.Random(9001)
    a, n = decide.Agenda(), Naive()
    for _ in range(2000):
        op, k = rng.random(), rng.randrange(25)
        if op < 0.6:
            p = rng.randrange(10) / 2
            a.add(k, p)
            n.d[k] = p
        elif op < 0.8:
            assert a.remove(k) == (n.d.pop(k, None) is not None)
        elif n.d:
            assert a.peek()[1] == max(n.d.values())
            assert a.pop() == n.pop()
        assert len(a) == len(n.d)


def test_modes(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([-1.0, 2.0, 3.0, -5.0])] + [(2, 9, -1.0)], "g int, id int, s double")
    got = {m: {r.id for r in df.withColumn("ok", f(["g"], "s", "s", ["id"])).where("ok").collect()} for m, f in decide.MODES.items()}
    assert got == {"AT_LEAST_ONE": {1, 2, 9}, "AT_MOST_ONE": {2}, "EXACTLY_ONE": {2, 9}}


def test_specs():
    assert decide.parse_spec("EXACTLY_ONE:argument4(t,f,s,k):t:k") == ("EXACTLY_ONE", "argument4", ["t", "f", "s", "k"], ["t", "k"])
    assert decide.parse_priority("0.5*easyfirst+1*dfs") == [(0.5, "easyfirst"), (1.0, "dfs")]
    with pytest.raises(ValueError):
        decide.parse_spec("SOMETIMES:a(x):x")
    with pytest.raises(ValueError):
        decide.parse_spec("EXACTLY_ONE:a(x):y")


def test_double_at_most_one(spark):
    df = spark.createDataFrame([(1, "a", "x", 0, 5.0), (1, "a", "y", 1, 4.0), (1, "b", "x", 2, 3.0), (1, "b", "y", 3, 2.0)], "doc int, a string, b string, id int, s double")
    out = decide.double_at_most_one(df, "doc", "a", "b", "s", "s", "id")
    assert {r.id for r in out.where("accepted").collect()} == {0, 3}


def test_unanimous_raises(spark):
    df = spark.range(1)
    assert df.select(decide.unanimous(F.lit(None).cast("boolean"), F.lit(True)).alias("d")).first().d is True
    with pytest.raises(Exception, match="differ"):
        df.select(decide.unanimous(F.lit(True), F.lit(False)).alias("d")).collect()


def test_rescoring(spark):
    df = spark.createDataFrame([("d", 1, 10.0, "g"), ("d", 2, 9.0, "g"), ("d", 3, 8.5, "h")], "doc string, k int, s double, g string")
    out = {r.k: (r.step, r.accepted) for r in decide.agenda_inference(df, "doc", "k", "s", "g", 5.0, 5.0).collect()}
    assert out == {1: (0, True), 3: (1, True), 2: (2, False)}


def test_mass_prefix_on_its_bound(spark):
    """Three quarters of equal values are three quarters of their sum; sums of doubles, and with them the SQL, may say more or less."""
    duckdb = pytest.importorskip("duckdb")
    sizes = [(v, n) for v in (0.1, 0.3, 1.1, 2.3, 29.27) for n in (1000, 4000, 6000)]
    rows = [(g, i, v) for g, (v, n) in enumerate(sizes) for i in range(n)]
    got = decide.mass_prefix(spark.createDataFrame(rows, "g int, i int, v double"), ["g"], "v", 0.75, ["i"]).groupBy("g").count().collect()
    sql = "SELECT count(*) FROM (SELECT coalesce(sum(v) OVER (PARTITION BY g ORDER BY v DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(v) OVER (PARTITION BY g) AS b FROM (SELECT 1 AS g, i, {}::DOUBLE AS v FROM range({}) t(i))) WHERE b < 0.75"
    assert {r.g: r["count"] for r in got} == {g: duckdb.connect().execute(sql.format(v, n)).fetchall()[0][0] for g, (v, n) in enumerate(sizes)}


def test_block_sums(spark):
    """Every sum is the exact one within a few roundings, whatever the size of the group; weights may be null."""
    from fractions import Fraction

    rng = random.Random(5)
    rows = [(g, i, None if rng.random() < 0.1 else rng.randrange(1, 30000) / 100) for g, n in enumerate((0, 1, 15, 16, 17, 255, 256, 257, 2048, 2049, 5000)) for i in range(n)]
    rows += [(99, i, None) for i in range(3)]
    got = {(r.g, r.i): (r._before, r._total) for r in decide.block_sums(spark.createDataFrame(rows, "g int, i int, v double"), ["g"], ["i"], "v").collect()}
    assert len(got) == len(rows)
    total = {g: sum(Fraction(v or 0) for h, _, v in rows if h == g) for g in {r[0] for r in rows}}
    before = dict.fromkeys(total, Fraction(0))
    for g, i, v in rows:
        b, t = got[g, i]
        assert b == pytest.approx(float(before[g]), rel=1e-14, abs=0) and (t is None) == (g == 99) and (t is None or t == pytest.approx(float(total[g]), rel=1e-12))
        before[g] += Fraction(v or 0)
