"""Perceptrons against plain loops, and the smaller operators that need a closer look."""

import random

from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import evaluate, extras, learn


def test_averaged_weights_are_the_mean_over_steps(spark):
    rng = random.Random(1)
    updates = [(rng.choice("abc"), rng.randrange(1, 21), rng.choice([-1.0, 0.5, 2.0])) for _ in range(40)]
    got = {r.feature: (r.final, r.average) for r in learn.averaged_weights(spark.createDataFrame(updates, "feature string, step long, delta double"), 20).collect()}
    for f in "abc":
        upto = [sum(d for g, s, d in updates if g == f and s <= t) for t in range(1, 21)]
        assert abs(got[f][0] - upto[-1]) < 1e-9 and abs(got[f][1] - sum(upto) / 20) < 1e-9


def plain_perceptron(rows, passes, margin):
    w, total, n = {}, {}, 0
    for _ in range(passes):
        for y, feats in rows:
            score = y * sum(w.get(f, 0.0) for f in feats)
            if (score < 1) if margin else (score <= 0):
                for f in feats:
                    w[f] = w.get(f, 0.0) + y
            n += 1
            for f, v in w.items():
                total[f] = total.get(f, 0.0) + v
    return {f: v / n for f, v in total.items()}


def test_perceptron_mixes_shards(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.choice([-1, 1]), [rng.choice("pqrst") for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "shard int, at long, y int, feats array<string>")
    for mode in ("plain", "margin"):
        parts = [plain_perceptron([(y, f) for s, _, y, f in rows if s == k], 2, mode == "margin") for k in range(3)]
        got = {r.feature: r.weight for r in learn.perceptron(df, "shard", "at", 2, mode).collect()}
        assert all(abs(got.get(f, 0.0) - sum(p.get(f, 0.0) for p in parts) / 3) < 1e-9 for f in "pqrst")
    scored = learn.linear_scores(df.select("at", "feats"), spark.createDataFrame([("p", 2.0)], "feature string, weight double"), "at").collect()
    assert {r["at"]: r.score for r in scored} == {i: 2.0 * f.count("p") for _, i, _, f in rows}


def test_gate_and_stopping(spark):
    e = spark.createDataFrame([("u", i, t) for i, t in enumerate([0, 5, 9, 10, 12, 25, 26])], "u string, k long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.k for r in extras.gated(e, ["u"], "ts", "k", 10).collect()) == [0, 3, 5]
    m = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 3.0, 2.0, 2.5, 2.0, 9.0])] + [("s", i, float(i)) for i in range(4)], "run string, step long, m double")
    assert {r.run: r.stop for r in evaluate.stopping_step(m, ["run"], "step", "m", 3).collect()} == {"r": 4, "s": None}


def test_target_heads(spark):
    cases = [(["DT", "NN", "IN", "NN"], 1), (["VB", "RP"], 0), (["``", "NN", "''"], 1), (["JJ", "WDT"], 0), (["."], 0), (["NN", "NN", "VB"], 1)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags array<string>")
    got = {r.i: r.h for r in df.select("i", text.target_head(F.col("tags"), F.lit(0), F.size("tags")).alias("h")).collect()}
    assert got == {i: h for i, (_, h) in enumerate(cases)}


def test_walks_do_not_turn_back(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y"), ("b", "c", "z")], "src string, dst string, rel string")
    got = {r.feature for r in extras.walk_features(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"/x=b", "/x/z=c"}
