from pyspark.sql import functions as F

from orrery.streaming import state


def test_documents_over_batches(spark, tmp_path):
    schema = "docid string, cmd string"
    src = str(tmp_path / "in")
    batches = [[("a", "x"), ("a", "x"), ("b", "x")], [("a", "done"), ("b", "x")], [("b", "done"), ("a", "x"), ("a", "done")]]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep = lambda df, _: got.extend((r.docid, r.consumed) for r in df.collect())
        state.listen(state.barrier_stream(state.stream_of(spark, src, schema)), keep, str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 2)]


def test_late_events_and_sessions(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) AS ts, 'u' AS u FROM VALUES (0), (10), (50), (55) t(m)")
    assert sorted(r.n for r in state.sessions(e, "30 minutes", ["u"]).collect()) == [2, 2]
    assert sorted(r.n for r in state.tumbling(e, "1 hour", ["u"]).collect()) == [4]
    assert state.sliding(e, "1 hour", "30 minutes", ["u"]).agg(F.sum("n")).first()[0] == 8
    assert state.reset(spark.createDataFrame([(True,), (False,)], "is_schema boolean")).count() == 1
