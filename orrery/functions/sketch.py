"""Frequency sketches as small relations: mergeable, joined rather than shipped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Odd multipliers and a prime for hashes that any SQL engine can repeat.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2166136261, 16777619, 1640531527)
PRIME = 2147483647


def arithmetic_bucket(key: Column, row: Column, buckets: int) -> Column:
    """(a * key + b) mod p mod buckets on whole-number keys."""
    a = F.element_at(F.array(*[F.lit(m % PRIME) for m in MULTIPLIERS]), row + 1)
    return F.pmod(F.pmod(key, F.lit(PRIME)) * F.pmod(a, F.lit(65521)) + row * 7919, F.lit(PRIME)) % F.lit(buckets)


def hashed_bucket(key: Column, row: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, row), F.lit(buckets))


def cells(df: DataFrame, key: str, rows: int, buckets: int, bucket=hashed_bucket) -> DataFrame:
    """A row for every hash row of every key, with its bucket."""
    r = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    return df.withColumn("row", r).withColumn("bucket", bucket(F.col(key), F.col("row"), buckets))


def max_min_sketch(counts: DataFrame, key: str, n: str, rows: int = 4, buckets: int = 1 << 12, bucket=hashed_bucket) -> DataFrame:
    """(row, bucket, value): the largest count of any key in a bucket; keys are set once."""
    return cells(counts, key, rows, buckets, bucket).groupBy("row", "bucket").agg(F.max(n).alias("value"))


def count_min_sketch(df: DataFrame, key: str, rows: int = 4, buckets: int = 1 << 12, n: Column | None = None, bucket=hashed_bucket) -> DataFrame:
    """(row, bucket, value): the sum of all counts in a bucket."""
    return cells(df, key, rows, buckets, bucket).groupBy("row", "bucket").agg(F.sum(n if n is not None else F.lit(1)).alias("value"))


def merged(*sketches: DataFrame, how: str = "max") -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "bucket").agg((F.max if how == "max" else F.sum)("value").alias("value"))


def estimates(keys: DataFrame, key: str, sketch: DataFrame, rows: int = 4, buckets: int = 1 << 12, bucket=hashed_bucket) -> DataFrame:
    """key and the least value of its buckets: an upper bound of its count."""
    probe = cells(keys.select(key).distinct(), key, rows, buckets, bucket)
    return probe.join(sketch, ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("value", F.lit(0))).alias("estimate"))


def clamped_df(estimate: Column, n_docs: Column) -> Column:
    return F.least(F.greatest(estimate, F.lit(1)), n_docs)


def conservative_sketch(df: DataFrame, key: str, order: str, parts: int = 8, rows: int = 4, bits: int = 12) -> DataFrame:
    """Conservative count-min: only a key's least cells rise. Depends on the order within a part; parts add up.

    A part's table has ``rows`` * 2 ** ``bits`` cells whatever its rows; rows stream through it.
    """
    k = F.xxhash64(key)
    dealt = df.select(k.alias("k"), F.col(order).alias("o")).withColumn("part", F.pmod(F.hash("k"), F.lit(parts)))
    counted = dealt.groupBy("part", "k").agg(F.min("o").alias("o"), F.count("*").alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((rows, 1 << bits), np.int64)
        r = np.arange(rows)
        for key_, n in pdf.sort_values(["o", "k"])[["k", "n"]].itertuples(index=False):
            cell = [((int(key_) * MULTIPLIERS[i] + i * 7919) % PRIME) & ((1 << bits) - 1) for i in range(rows)]
            now = table[r, cell]
            table[r, cell] = np.maximum(now, now.min() + n)
        i, b = np.nonzero(table)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "row": i.astype("int32"), "bucket": b.astype("int64"), "value": table[i, b]})

    return counted.groupBy("part").applyInPandas(fold, "part int, row int, bucket long, value long")


def heavy_hitters(freqs: DataFrame, key: str, tok: str, doc: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` keys of largest tok + doc + F1(tok, doc), and all others."""
    t, d = F.col(tok), F.col(doc)
    weight = t + d + F.when(t + d > 0, 2 * t * d / (t + d)).otherwise(0)
    top = freqs.withColumn("weight", weight).orderBy(F.desc("weight"), key).limit(k)
    return top, freqs.join(top.select(key), key, "left_anti")


def bucket_cardinality(freqs: DataFrame, key: str, n: str, bits: int, hashed: Column | None = None) -> DataFrame:
    """Largest frequency by masked hash."""
    h = F.hash(key) if hashed is None else hashed
    return freqs.groupBy(h.bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")).agg(F.max(n).alias("n"))


def first_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
