"""The registered queries against their SQL, the pipeline end to end, at the smallest scale."""

import duckdb
import numpy as np
import pytest

from orrery.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in ORACLE_SQL:
        rel = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        ix = [names.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in ix) for r in rel.fetchall())


def test_pipeline(spark):
    """Every stage against a brute-force version of it, on what the stage before it kept."""
    import corpus_pipeline
    from orrery.llm import quality_model, quality_rules, queries
    from orrery.llm.words import load_tokenizer

    from .test_operators import brute_words, near_truth

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, raw = docs.columns, docs
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and got and set(got) <= set(now), name
        if name == "quality_rules":
            judged = {i: quality_rules.judge(t or "", quality_rules.LineRules()) for i, t in now.items()}
            want = {i: j[-1] for i, j in judged.items() if j[-2]}
        elif name == "quality_classifier":
            model = queries.quality_model(spark, raw, SF)
            x = np.array([model.differences(t.encode(), model.compressors()) for t in now.values()])
            want = {i: t for (i, t), s in zip(now.items(), model.score(x), strict=True) if s >= 0.3}
            assert isinstance(model, quality_model.Model)
        elif name == "near_dedup":
            ids = sorted(now)
            truth = near_truth([now[i] for i in ids], 5, 80)
            want = {i: now[i] for k, i in enumerate(ids) if truth[k][1] == k}
        else:
            ids = sorted(now)
            truth = brute_words([now[i] for i in ids], 20)
            want = {i: truth[k][2].decode() if truth[k][1] else now[i] for k, i in enumerate(ids)}
        assert got == want, name
        now = got
    tok = load_tokenizer(queries.tokenizer_file("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r[1] for r in pieces} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in now.items()}
