"""Filters, neighbourhoods and set operations over fact tables (rel, args, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_relation(facts: DataFrame, rel: str) -> DataFrame:
    return facts.where(F.col("rel") == rel)


def matching(facts: DataFrame, rel: str, at: int, value: str) -> DataFrame:
    return facts.where((F.col("rel") == rel) & (F.get("args", F.lit(at)) == value))


def only_one(df: DataFrame) -> DataFrame:
    """``df`` if it has exactly one row; otherwise running it raises."""
    n = df.agg(F.count("*").alias("n"))
    ok = n.select(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("rows: "), F.col("n").cast("string"))).cast("boolean")).alias("ok"))
    return df.crossJoin(F.broadcast(ok)).where("ok").drop("ok") if df.columns else df  # one row


def adjacency(facts: DataFrame) -> DataFrame:
    """(node, rel, at, args): an edge between every fact and every argument."""
    return facts.select("rel", "args", F.posexplode("args").alias("at", "node")).select("node", "rel", "at", "args")


def neighbours(facts: DataFrame, node: str, at: int | None = None) -> DataFrame:
    out = adjacency(facts).where(F.col("node") == node)
    return out.where(F.col("at") == at) if at is not None else out


def one_hop(facts: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Nodes that share a fact with the frontier and were not visited."""
    a = adjacency(facts)
    touched = a.join(frontier, "node", "left_semi").select("rel", "args").distinct()
    return touched.select(F.explode("args").alias("node")).distinct().join(visited, "node", "left_anti")


def kept_relations(facts: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One of an include list, an exclude list, or all."""
    if include and exclude:
        raise ValueError("include or exclude, not both")
    if include:
        return facts.where(F.col("rel").isin(*include))
    return facts.where(~F.col("rel").isin(*exclude)) if exclude else facts


def documents_with(facts: DataFrame, rels: list[str], doc: str = "docid") -> DataFrame:
    """All facts of documents that have a fact of one of the relations."""
    return facts.join(facts.where(F.col("rel").isin(*rels)).select(doc).distinct(), doc, "left_semi")


def renamed(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    return facts.replace(names, subset=["rel"]) if names else facts


def without_role_suffix(facts: DataFrame, role: Column, suffix: str = "/C") -> DataFrame:
    return facts.where(~F.coalesce(role.endswith(suffix), F.lit(False)))


def union_documents(a: DataFrame, b: DataFrame, doc: str = "docid", **kw) -> DataFrame:
    """Distinct union of two files with the same documents; others raise when run."""
    a, b = kept_relations(a, kw.get("include_a"), kw.get("exclude_a")), kept_relations(b, kw.get("include_b"), kw.get("exclude_b"))
    ids = a.select(doc).distinct().withColumn("l", F.lit(1)).join(b.select(doc).distinct().withColumn("r", F.lit(1)), doc, "full_outer")
    bad = ids.where("l IS NULL OR r IS NULL").select(F.raise_error(F.concat(F.lit("only on one side: "), doc)).cast("string").alias(doc))
    out = a.unionByName(b).dropDuplicates()
    return out.join(bad, doc, "left_anti")


def insert(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """State with the facts of ``new`` it lacks; an equal fact keeps its first score."""
    w = Window.partitionBy(*key).orderBy("_side")
    both = state.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def with_schema_facts(per_doc: DataFrame, schema: DataFrame) -> DataFrame:
    """Facts of documents and the permanent ones, which belong to no document."""
    return per_doc.unionByName(schema, allowMissingColumns=True)


def not_known(candidates: DataFrame, *known: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that are neither pending nor accepted."""
    return reduce(lambda d, k: d.join(k, key, "left_anti"), known, candidates)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with sign - (a) and + (b)."""
    return a.exceptAll(b).withColumn("sign", F.lit("-")).unionByName(b.exceptAll(a).withColumn("sign", F.lit("+")))


def key_value_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys and, for keys of both, rows on one side only."""
    keys = diff(a.select(*key).distinct(), b.select(*key).distinct()).withColumn("what", F.lit("key"))
    both = a.select(*key).distinct().intersect(b.select(*key).distinct())
    rows = diff(a.join(both, key, "left_semi"), b.join(both, key, "left_semi")).select(*key, "sign").withColumn("what", F.lit("value"))
    return keys.unionByName(rows)


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    return diff(a.select(*key).distinct(), b.select(*key).distinct()).isEmpty()


def grouped(facts: DataFrame, at: list[int]) -> DataFrame:
    """Facts by relation and the arguments at some places."""
    keys = [F.get("args", F.lit(i)).alias(f"k{i}") for i in at]
    return facts.groupBy("rel", *keys).agg(F.count("*").alias("n"), F.collect_set("args").alias("facts"))


def violations(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def multimap(df: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort((F.collect_set if distinct else F.collect_list)(value)).alias("values"))


def runs(df: DataFrame, order: list, key: str, by: list[str]) -> DataFrame:
    """Adjacent rows of equal key, in order within ``by``, as groups."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    marked = df.withColumn("_start", start).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", key).agg(F.count("*").alias("n"))


def succession(df: DataFrame, by: str, order: str) -> DataFrame:
    """(by, i, j): every place and the next one."""
    w = Window.partitionBy(by).orderBy(order)
    return df.select(by, F.col(order).alias("i"), F.lead(order).over(w).alias("j")).where("j IS NOT NULL")


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs ``least`` times or more."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def dense_rows(entries: DataFrame, row: str, col: str, n: str, least_entry: int, least_nnz: int, least_sum: int) -> DataFrame:
    """Entries of at least ``least_entry`` in rows that keep enough of them and a large enough sum."""
    big = entries.where(F.col(n) >= least_entry)
    rows = big.groupBy(row).agg(F.countDistinct(col).alias("nnz"), F.sum(n).alias("z")).where((F.col("nnz") >= least_nnz) & (F.col("z") >= least_sum))
    return big.join(rows.select(row), row, "left_semi")


def dense_core(entries: DataFrame, row: str, col: str, least: int) -> DataFrame:
    """Entries left when rows and columns with fewer than ``least`` entries are dropped again and again."""
    from ..plans.lineage import cut

    n, m = None, entries.count()
    while m != n:
        entries = cut(frequent(frequent(entries, row, least), col, least))
        n, m = m, entries.count()
    return entries


def span_index(spans: DataFrame, query: DataFrame, kind: str) -> DataFrame:
    """Pairs of a query and a span of the same document that starts or ends with it, contains it or crosses it."""
    a, b = spans.alias("a"), query.alias("q")
    s, e, qs, qe = F.col("a.start"), F.col("a.end"), F.col("q.start"), F.col("q.end")
    on = {
        "start": s == qs, "end": e == qe, "contains": (s <= qs) & (qe <= e), "within": (qs <= s) & (e <= qe),
        "crosses": ((s < qs) & (qs < e) & (e < qe)) | ((qs < s) & (s < qe) & (qe < e)),
    }[kind]
    return b.join(a, (F.col("a.doc") == F.col("q.doc")) & on).select(F.col("q.doc").alias("doc"), qs.alias("q_start"), qe.alias("q_end"), s.alias("start"), e.alias("end"))


def mention_pairs(mentions: DataFrame, sent: str, at: str, most: int) -> DataFrame:
    """Pairs i < j of a sentence that lie at most ``most`` words apart."""
    a = mentions.select(sent, F.col(at).alias("i"), *[F.col(c).alias(f"{c}_i") for c in mentions.columns if c not in (sent, at)])
    b = mentions.select(sent, F.col(at).alias("j"), *[F.col(c).alias(f"{c}_j") for c in mentions.columns if c not in (sent, at)])
    return a.join(b, sent).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= most))


def resolved_mentions(queries: DataFrame, mentions: DataFrame) -> DataFrame:
    """For each query (doc, begin, finish) the shortest mention that covers its characters."""
    hit = queries.join(mentions, "doc").where((F.col("start") <= F.col("begin")) & (F.col("finish") <= F.col("end")))
    w = Window.partitionBy("doc", "begin", "finish").orderBy(F.col("end") - F.col("start"), "start")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_null_spans(candidates: DataFrame, filled: DataFrame, key: list[str]) -> DataFrame:
    """Chosen arguments, and a null span for every role that has none."""
    missing = candidates.select(*key).distinct().join(filled, key, "left_anti").withColumn("start", F.lit(-1)).withColumn("end", F.lit(-1))
    return filled.select(*key, "start", "end").unionByName(missing.select(*key, "start", "end"))
