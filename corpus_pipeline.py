"""Corpus pipeline: quality rules, quality classifier, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``, others that docs may have included.

Edge cases: null text counts as empty, and an empty text fails the quality rules; rows
without doc_id are kept by near-dedup and count as the least in substring dedup; repeated
rows are one document to near-dedup; an empty table passes through all stages as an empty
table; a very long text is held by one task at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import near_dedup, packing, quality_model, quality_rules, queries, substring_dedup
from orrery.llm.arrow import checkpoint_dir, scratch


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much text."""
    return quality_rules.clean(docs)


def by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go. The model learns from the raw table, which still has the bad ones."""
    model = queries.quality_model(spark, queries.table(spark, sf_dir, "documents"), sf_dir)
    return quality_model.select(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate component stays."""
    return near_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand earlier in the corpus are cut out."""
    return substring_dedup.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality_rules", by_rules), ("quality_classifier", by_model), ("near_dedup", one_of_each), ("substring_dedup", without_repeats), ("packing", packed)]

#: SQL can express neither the compression model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; the stages' tables lie in the shared checkpoint folder.

    What a stage writes for itself goes when its table is there.
    """
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
