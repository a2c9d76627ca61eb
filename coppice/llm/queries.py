"""Queries of the training-data operators, with their contract's parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, minhash, packing, pii, quality, suffixes, token_counts, tokens, topk
from .arrow import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", k=5, scale=256)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of over 50 words may have less than the contract's 400 bytes: they are counted in further columns.
    return suffixes.report(spark, documents(spark, sf_dir), length=400, words=51)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(spark, documents(spark, sf_dir), k=4, percent=80)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cap=1024, end=2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_topk, op3_bpe_round_trip, op4_suffix_dedup, op5_token_counts, op6_minhash_dedup, op7_chat_format, op8_best_fit_packing, op9_license_scan, op10_pii)}
