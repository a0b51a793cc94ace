import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import sketch, text, vectors
from orrery.operators import evaluate, facts, retrieval, sample, summarize


def test_sketches_are_upper_bounds(spark):
    df = spark.range(2000).select((F.col("id") * F.col("id") % 97).alias("k"))
    true = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for est in (sketch.estimates(df, "k", sketch.count_min_sketch(df, "k", 3, 64), 3, 64), sketch.estimates(df, "k", sketch.max_min_sketch(df.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 3, 64), 3, 64)):
        got = {r.k: r.estimate for r in est.collect()}
        assert all(got[k] >= n for k, n in true.items())


def test_quality_without_predictions(spark):
    g, p = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int")
    r = evaluate.quality(g, p, ["k"], []).first()
    assert (r.tp, r.fp, r.fn, r.p, r.r) == (0, 0, 1, 1.0, 0.0)


def test_knapsack_and_summary_against_brute_force(spark):
    rng = random.Random(3)
    items = [("g", i, float(rng.randrange(1, 20)), float(rng.randrange(1, 30))) for i in range(9)]
    best = max(sum(x[2] for x in c) for n in range(10) for c in itertools.combinations(items, n) if sum(x[3] for x in c) <= 50)
    out = summarize.knapsack(spark.createDataFrame(items, "g string, i int, v double, w double"), "g", "i", "v", "w", 50.0, 50).collect()
    assert out[0].total == best
    rows = [("e", s, 3 + s % 3, c, float(c + 1)) for s in range(7) for c in rng.sample(range(8), 3)]
    cover = {}
    for _, s, n, c, w in rows:
        cover.setdefault(s, (n, {}))[1][c] = w
    best = max(sum({k: v for s in c for k, v in cover[s][1].items()}.values()) for n in range(8) for c in itertools.combinations(cover, n) if sum(cover[s][0] for s in c) <= 11)
    out = summarize.coverage_summary(spark.createDataFrame(rows, "e string, sent int, length int, concept int, weight double"), "e", 11).first()
    assert out.value == best


def test_large_summary_is_exact(spark):
    """Groups beyond 18 sentences, against every set of concepts that sentences can cover."""
    rng = random.Random(5)
    rows = [(e, s, 2 + (5 * s + e) % 7, c, float(c + 1)) for e in range(20) for s in range(24) for c in rng.sample(range(12), rng.randrange(1, 5))]
    best = {}
    for e in range(20):
        cover, states = {}, {0: 0}  # concepts covered, least length
        for _, s, n, c, _ in (r for r in rows if r[0] == e):
            cover[s] = (n, cover.get(s, (n, 0))[1] | 1 << c)
        for n, m in cover.values():
            for k, used in list(states.items()):
                if used + n <= 15 and states.get(k | m, 16) > used + n:
                    states[k | m] = used + n
        best[e] = max(sum(c + 1.0 for c in range(12) if m >> c & 1) for m in states)
    out = summarize.coverage_summary(spark.createDataFrame(rows, "e int, sent int, length int, concept int, weight double"), "e", 15).collect()
    assert {r.e: r.value for r in out} == best
    for e in best:
        picked = {r.sent for r in out if r.e == e}
        assert sum(2 + (5 * s + e) % 7 for s in picked) <= 15
        assert sum(c + 1 for c in {r[3] for r in rows if r[0] == e and r[1] in picked}) == best[e]


def test_dense_core_of_a_chain(spark):
    """A path that loses its free end a round, for more than 20 rounds, tied to a square that stays."""
    path = [(100, 0)] + [(i, i) for i in range(23)] + [(i, i + 1) for i in range(22)]
    square = [(100 + i, 100 + j) for i in range(2) for j in range(2)]
    got = facts.dense_core(spark.createDataFrame(path + square, "r int, c int"), "r", "c", 2).collect()
    assert sorted((x.r, x.c) for x in got) == square


def test_tree_distance():
    a = (["f", "d", "e", "a", "c", "b"], [-1, 0, 0, 1, 1, 4])
    b = (["f", "c", "e", "d", "a", "b"], [-1, 0, 0, 1, 3, 3])
    assert summarize.tree_distance(a, b) == 2
    assert summarize.tree_distance(a, a) == 0


def test_near_duplicates(spark):
    rows = [("s", 0, "a", {"x": 1.0}), ("s", 1, "b", {"x": 2.0}), ("s", 2, "c", {"y": 1.0}), ("s", 3, "d", None), ("s", 4, "e", {"x": 1.0})]
    df = spark.createDataFrame(rows, "block string, rank int, key string, vec map<string,double>")
    assert {r.key: r.canonical for r in retrieval.near_duplicates(df, "block", 0.9).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "a"}


def test_text_functions(spark):
    df = spark.createDataFrame([(["DT", "JJ", "NNS", "NNS"], "Jean-Paul 1999")], "tags array<string>, m string")
    r = df.select(text.pos_pattern(F.col("tags")).alias("p"), text.gram_features(F.col("m")).alias("g"), text.majority(F.col("tags")).alias("top")).first()
    assert r.p == "D J N+" and r.top == "NNS"
    assert r.g == ["pi:jean", "pi:paul", "pi:0000", "pb:BBBB_jean", "pb:jean_paul", "pb:paul_0000", "pb:0000_AAAA"]


def test_mention_features(spark):
    df = spark.createDataFrame([("the Bob", ["Bob", "A12345", "s"])], "m string, h array<string>")
    got = df.select(text.mention_features(F.col("m"), F.col("h")).alias("f")).first().f
    assert got == ["pi:bob", "pb:the_bob", "pb:bob_AAAA", "h:Bob", "hi:bob", "h:A00000", "hi:a12345", "hp:A12345"]


def test_vectors(spark):
    df = spark.createDataFrame([([("a", 1.0), ("b", 2.0), ("a", 1.0)], [("a", 3.0)], [])], f"x {vectors.FEATS}, y {vectors.FEATS}, z {vectors.FEATS}")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = df.select(vectors.cosine(x, y)["cos"].alias("c"), vectors.cosine(x, z)["cos"].alias("c0"), vectors.mean(z).alias("m"), vectors.names(vectors.by_weight(vectors.indexed(x), 1)).alias("t")).first()
    assert abs(r.c - 2 / 8**0.5) < 1e-12 and r.c0 == 0 and r.m == 0 and r.t == ["a"]


def test_sets_and_spans(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "a"), ("u", 5, None), ("u", 6, None)], "u string, o int, k string")
    assert [(r.k, r.n) for r in facts.runs(df, ["o"], "k", ["u"]).orderBy("run").collect()] == [("a", 2), ("b", 1), ("a", 1), (None, 2)]
    s = sample.stratified(spark.range(40).withColumn("n", F.col("id") + 1), "n", F.col("id"), 1, 1)
    assert {(r.bucket, r.section): r["count"] for r in s.groupBy("bucket", "section").count().collect()}[(3, "test")] == 1


def test_weighted_choice_is_fair(spark):
    df = spark.range(3000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("id", (F.col("id") * 2 + F.col("i")).alias("item"), "i")
    got = sample.weighted_choice(df, ["id"], "item", F.when(F.col("i") == 1, 3.0).otherwise(1.0)).where("item % 2 = 1").count()
    assert 2100 < got < 2400


def test_intersective_takes_features_of_any_length(spark):
    """A feature beyond 8,000,000 postings still counts, unless the caller names a bound."""
    long = spark.range(8_000_001).select(F.lit("x").alias("feat"), F.col("id").alias("tok"))
    f2t = long.union(spark.createDataFrame([("y", 5), ("y", 9)], "feat string, tok long"))
    q = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "feat string, s double")
    assert sorted(map(tuple, retrieval.intersective(f2t, q).collect())) == [(5, 6.0), (9, 6.0)]
    assert retrieval.intersective(f2t, q, 8_000_000).isEmpty()


def test_clear_summaries_need_no_search(spark):
    """Groups that fit and share no weight come from windows, others from the search; both are the best by brute force."""
    rng = random.Random(8)
    rows = []
    for e in range(60):
        disjoint, at = e % 2 == 0, 0
        for s in range(rng.randrange(1, 6)):
            for _ in range(rng.randrange(1, 4)):
                rows.append((e, s, 2 + s % 2, 10 + at if disjoint else rng.randrange(5)))
                at += 1
    weight = {(e, c): float(rng.choice([0, 1, 2, 5] if e % 3 else [-2, 0, 3])) for e, _, _, c in rows}
    rows = [(*r, weight[r[0], r[3]]) for r in dict.fromkeys(rows)]
    df = spark.createDataFrame(rows, "e int, sent int, length int, concept int, weight double")
    clear = {r.e for r in summarize.clear_choice(df, "e", 9).where("_clear").collect()}
    got = {}
    for r in summarize.coverage_summary(df, "e", 9).collect():
        got.setdefault(r.e, (r.value, set()))[1].add(r.sent)
    assert 5 < len(clear) < 55
    for e in range(60):
        cover = {}
        for _, s, n, c, _ in (r for r in rows if r[0] == e):
            cover.setdefault(s, (n, set()))[1].add(c)
        value = lambda pick: sum(weight[e, c] for c in set().union(*(cover[s][1] for s in pick)))  # noqa: B023, E731
        sets = [p for n in range(len(cover) + 1) for p in itertools.combinations(cover, n) if sum(cover[s][0] for s in p) <= 9]
        best = max(map(value, sets))
        assert got.get(e, (0.0, set()))[0] == best
        if e in got:
            assert value(got[e][1]) == best and sum(cover[s][0] for s in got[e][1]) <= 9
        if e in clear:
            assert got.get(e, (0.0, set()))[1] == {s for s in cover if any(weight[e, c] > 0 for c in cover[s][1])}


def test_near_duplicates_as_one_by_one(spark):
    """Blocks of many rows in parts, against a plain loop; a block's rows never meet in one frame."""
    rng = random.Random(6)
    bases = [{f"w{rng.randrange(60)}": float(rng.randrange(1, 6)) for _ in range(12)} for _ in range(120)]
    rows = []
    for i in range(700):
        v = dict(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            v[f"w{rng.randrange(60)}"] = float(rng.randrange(1, 4))
        rows.append((rng.choice(["s", None]), i // 2, i, {} if i % 97 == 0 else None if i % 101 == 0 else v))
    df = spark.createDataFrame(rows, "block string, rank int, key int, vec map<string,double>").repartition(7)

    def plain(most):
        out = {}
        for block in ("s", None):
            kept, seen = [], {}
            for _, _, key, v in sorted((r for r in rows if r[0] == block), key=lambda r: r[1:3]):
                same, norm = tuple(sorted((v or {}).items())), sum(x * x for x in (v or {}).values()) ** 0.5
                if same not in seen:
                    hit = next((k for k, u, m in kept if norm and m and sum(x * u.get(t, 0.0) for t, x in v.items()) / (norm * m) > 0.9), None)
                    if hit is None:
                        if most and len(kept) >= most:
                            break
                        kept.append((key, v or {}, norm))
                    seen[same] = key if hit is None else hit
                out[key] = seen[same]
        return out

    for most in (0, 60):
        out = retrieval.near_duplicates(df, "block", 0.9, most)
        assert {r.key: r.canonical for r in out.collect()} == plain(most)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_parts_multiply_as_matrices():
    rng = np.random.default_rng(2)
    full = rng.integers(0, 4, (90, 200)) * (rng.random((90, 200)) < np.linspace(0, 0.5, 200))
    sparse = lambda x: ([np.flatnonzero(r) - 100 for r in x], [r[r > 0].astype(float) for r in x])
    assert (retrieval.Part(*sparse(full[:70])).dots(*sparse(full[70:])) == full[70:] @ full[:70].T).all()
