"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, embedding_dedup, knn_join, language_id, license_scan, near_dedup, packing, preference_format, repair_shards, secret_scan
from tessera.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.format_preferences(preference_format.by_neighbours(table(spark, sf_dir, "conversations")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_shards.encode_and_read_back(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_knn_join, op3_preference_format, op4_secret_scan, op5_language_id, op6_byte_bpe, op7_license_scan, op8_packing, op9_repair_shards, op10_embedding_dedup)}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the tests hold the others against brute force."""
    return {
        "op2_knn_join": knn_join.ORACLE_SQL,
        "op3_preference_format": preference_format.ORACLE_SQL,
        "op4_secret_scan": secret_scan.ORACLE_SQL,
        "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    }
