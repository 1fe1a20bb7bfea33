"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voltpoint.llm import decontaminate, language, licenses, manifest, mixing, neardup, packing, phrases, quality, secrets, sharding, substrings, tokens
from voltpoint.llm.oracle import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op9_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


#: Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(_table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [op1_licenses, op2_language, op3_mixing, op4_sharding, op5_tokens, op6_quality, op7_secrets, op8_substrings, op9_benchmark, op10_near_duplicates, op11_manifest, op12_collocations, op13_packing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
