"""Sinks: facts, partitions, index tables, VW lines, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_text(facts: DataFrame) -> DataFrame:
    """One line a fact: command, relation and arguments joined by a space."""
    return facts.select(F.concat_ws(" ", "cmd", "rel", F.array_join("args", " ")).alias("value"))


def write_facts(facts: DataFrame, path: str) -> None:
    fact_text(facts).write.text(path)


def state_dump(facts: DataFrame, skip: list[str] | None = None, cmd: str = "yhat") -> DataFrame:
    """Lines of all facts but those of the skipped relations, by relation and arguments."""
    kept = facts.where(~F.col("rel").isin(*skip)) if skip else facts
    return fact_text(kept.withColumn("cmd", F.lit(cmd)).orderBy("rel", "args"))


def write_partitions(docs: DataFrame, part: Column, path: str, fmt: str = "parquet") -> None:
    """Documents by ``part`` into folders; null drops the document."""
    docs.withColumn("part", part).where("part IS NOT NULL").write.partitionBy("part").format(fmt).save(path)


def write_index(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """The postings tables under ``path``; appending does not remove duplicates."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").csv(path)


def vw_text(df: DataFrame, y: str = "y", ns: str = "ns") -> DataFrame:
    """VW lines: label, then |name and its features."""
    return df.select(F.concat_ws(" ", F.col(y).cast("string"), F.array_join(F.transform(ns, lambda n: F.concat(F.lit("|"), n["name"], F.lit(" "), F.array_join(n["feats"], " "))), " ")).alias("value"))


def hash_log(terms: DataFrame, term: str = "term") -> DataFrame:
    """Reversible hashes: one row a distinct (hash, term)."""
    return terms.select(F.hash(term).alias("hash"), F.col(term).alias("term")).distinct()


def write_weights(weights: DataFrame, path: str) -> None:
    """Weights by relation, one folder each."""
    weights.write.partitionBy("rel").parquet(path)


def binary_features(df: DataFrame, feats: str = "feats") -> DataFrame:
    """Length-prefixed template and feature numbers of a line, as four-byte big-endian values."""
    num = lambda c: F.lpad(F.hex(c), 8, "0")
    body = F.array_join(F.transform(feats, lambda p: F.concat(num(p["t"]), num(p["f"]))), "")
    return df.withColumn("packed", F.unhex(F.concat(num(F.size(feats)), body)))


def unpacked_features(df: DataFrame, packed: str = "packed") -> DataFrame:
    """The inverse of binary_features()."""
    num = lambda at: F.conv(F.substring(F.hex(F.col(packed)), at, F.lit(8)), 16, 10).cast("int")
    n = num(F.lit(1))
    return df.withColumn("feats", F.when(n == 0, F.array().cast("array<struct<t:int,f:int>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(num(9 + 16 * i).alias("t"), num(17 + 16 * i).alias("f")))))
