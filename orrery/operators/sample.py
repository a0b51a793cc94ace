"""Samples, splits, shards and weighted choices, all repeatable by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) fixed by the keys."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def arithmetic_unit(key: Column, a: int = 7919, c: int = 104729, m: int = 1000003) -> Column:
    """A number in [0, 1) that any SQL engine can repeat, for whole-number keys."""
    return F.pmod(key * a + c, F.lit(m)) / float(m)


def by_lists(col: Column, test: list[str], dev: list[str]) -> Column:
    return F.when(col.isin(*test), "test").when(col.isin(*dev), "dev").otherwise("train")


def by_table(df: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    return df.join(sections.select(key, "section"), key, "left").withColumn("section", F.coalesce("section", F.lit("train")))


def in_blocks(df: DataFrame, by: list[str], order: list[str], n: int, compat: bool = True) -> DataFrame:
    """Blocks of ``n`` rows; with ``compat`` the first block is one short."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - (0 if compat else 1)
    return df.withColumn("block", F.floor(at / n).cast("int"))


def stratified(df: DataFrame, freq: str, key: Column, n_test: int, n_dev: int, base: float = 2.0) -> DataFrame:
    """Buckets of geometric frequency; in each, the first ``n_test`` by hash are test, the next ``n_dev`` dev."""
    bucket = F.floor(F.log(F.col(freq).cast("double")) / F.log(F.lit(base)) + 1e-9).cast("int")
    at = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    return df.withColumn("bucket", bucket).withColumn("_at", at).withColumn("section", F.when(F.col("_at") <= n_test, "test").when(F.col("_at") <= n_test + n_dev, "dev").otherwise("train")).drop("_at")


def bernoulli(df: DataFrame, key: Column, p: float, seed: int = 0, draw: Column | None = None) -> DataFrame:
    return df.where((unit(key, seed=seed) if draw is None else draw) < p)


def reservoir(df: DataFrame, by: list[str], key: Column, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """``n`` rows a group, drawn evenly."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(key, F.lit(seed)) if draw is None else draw, key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def weighted_choice(df: DataFrame, by: list[str], item: str, weight: Column, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """One item a group, with probability in proportion to its weight; of equals the least."""
    wait = -F.log(unit(F.col(item), seed=seed) if draw is None else draw) / weight
    return df.where(weight > 0).groupBy(*by).agg(F.min_by(item, F.struct(wait, item)).alias(item))


def weighted_key(df: DataFrame, key: str, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """A key with probability in proportion to its rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min_by(key, F.struct(-F.log(unit(F.col(key), seed=seed) if draw is None else draw) / F.col("n"), key)).alias(key))


def sharded(df: DataFrame, key: Column, n: int, i: int, hashed: Column | None = None) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key) if hashed is None else hashed, F.lit(n)) == i)


def shuffled(df: DataFrame, doc: str, order: str, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Documents in hash order, rows of each in their own."""
    return df.orderBy(F.xxhash64(F.col(doc), F.lit(seed)) if draw is None else draw, doc, order)


def grid(**options: DataFrame) -> DataFrame:
    """All combinations of small option tables, numbered."""
    out = None
    for df in options.values():
        out = df if out is None else out.crossJoin(F.broadcast(df))  # option tables
    return out.withColumn("job", F.row_number().over(Window.orderBy(*out.columns)) - 1)


def sampled_pairs(df: DataFrame, label: str, fractions: dict[str, float], key: Column, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Rows drawn by label at given rates."""
    out = F.lit(False)
    for v, p in fractions.items():
        out |= (F.col(label) == v) & ((unit(key, seed=seed) if draw is None else draw) < p)
    return df.where(out)


def random_products(templates: DataFrame, name: str, mean: float, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """``n`` feature sets; each template is in a set with the chance that gives ``mean`` of them."""
    total = templates.agg(F.count("*").alias("_total"))
    sets = templates.sparkSession.range(n).withColumnRenamed("id", "set")
    rows = sets.crossJoin(F.broadcast(templates)).crossJoin(F.broadcast(total))  # template names are few
    return rows.where((unit(F.col("set"), F.col(name), seed=seed) if draw is None else draw) < mean / F.col("_total")).select("set", name)


def unique_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
