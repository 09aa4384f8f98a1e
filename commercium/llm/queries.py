"""The operators as named queries over a folder of tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from commercium.llm import (
    alignment,
    exact,
    infill,
    language,
    near,
    packing,
    pieces,
    quality,
    sharding,
    substrings,
    syncmers,
    token_files,
    toxicity,
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(read(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_id(read(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(read(spark, folder, "documents"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_dedup(read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(read(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digests(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.infill_digests(read(spark, folder, "documents"))


def op12_cross_alignment(spark: SparkSession, folder: str) -> DataFrame:
    byte, piece = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.cross_alignment(read(spark, folder, "documents"), byte, piece)


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.text_fingerprints(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_near_dedup,
        op3_language_id,
        op4_exact_dedup,
        op5_sharding,
        op6_substring_dedup,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_merge_dropout,
        op10_token_files,
        op11_fill_in_middle,
        op12_cross_alignment,
        op13_fingerprints,
    )
}

ORACLES = {"op4_exact_dedup": exact.ORACLE, "op7_quality_rules": quality.oracle()}
