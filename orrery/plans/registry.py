"""Where queries and the SQL they are held against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)  # one frame a table, so that its columns can be named
        return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer splits than that, as a small file of one row group has.

    For plans that do much work a row; larger tables come in enough splits and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables."""

    def wrap(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return wrap
