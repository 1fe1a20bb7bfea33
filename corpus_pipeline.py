"""The corpus pipeline: quality, near-duplicates, benchmark, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltpoint.llm import decontaminate, mixing, neardup, quality, sharding
from voltpoint.llm.common import staged
from voltpoint.llm.queries import SHARD_BYTES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the perplexity band.

    Null and empty texts fail; repeated rows stay or go together; an empty table
    stays one."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from 80 % on: the
    smallest id, of rows with that id one. Texts without words link with nothing
    and stay."""
    return neardup.one_of_each(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that the benchmark has, too.

    No document goes; a text that was nothing but a passage becomes empty, null
    stays null, and ``n_chars`` follows the text."""
    return decontaminate.remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, some twice, in training order.

    Documents without words are taken by no mix; a null source is a source."""
    return mixing.training_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard.

    Null and empty texts are placed, too. Columns of the input that are named
    ``shard`` or ``shard_bytes`` give way to this stage's."""
    placed = sharding.shard_documents(docs, SHARD_BYTES)
    named = [f"doc.`{c}`" for c in docs.columns if c not in ("shard", "shard_bytes")]
    return placed.select(*named, "shard", "shard_bytes")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: The perplexity and sketching stages have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
