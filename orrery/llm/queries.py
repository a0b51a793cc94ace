"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), with_text=False)


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from .quality_model import fit

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return fit(docs, labels.where(~held_out()))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import score

    docs = table(spark, sf_dir, "documents")
    return score(docs, quality_model(spark, docs, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import encode

    docs = table(spark, sf_dir, "documents")
    return encode(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals of ``documents`` as shards, compacted; the rows of the version reached, and whether it has fewer shards."""
    import uuid

    from .arrow import checkpoint_dir
    from .sharding import ShardStore

    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", docs.schema)
    last = store.append_all(docs, F.pmod(F.xxhash64("doc_id"), F.lit(16)))[-1:]
    before = store.manifest(last[0]).count() if last else 0
    version = store.compact()
    fewer = store.manifest(version).count() < before
    store.vacuum()
    return store.read(version).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), F.lit(fewer).alias("compacted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_bytes

    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_words

    out = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import NearRules, near_components

    out = near_components(table(spark, sf_dir, "documents"), NearRules(shingle=3, percent=85, bands=24))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import near_vectors

    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op5_quality_rules": sql.QUALITY_RULES,
    "op6_suffix_dedup": sql.SUFFIX_DEDUP,
    "op7_sharding": sql.SHARDING,
    "op9_substring_dedup": sql.SUBSTRING_DEDUP,
    "op10_near_dedup": sql.NEAR_DEDUP,
}
