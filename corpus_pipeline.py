"""The corpus pipeline: documents to shards. Each stage works on all its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tillwork.llm import decontamination, kd_shards, mixing, near_dup, quality_rules, tables

SHARDS = 40
ORACLE_SQL = None  # expectation-maximisation and signatures are beyond SQL; tests hold the stages against brute force


def _stage(work: Callable) -> Callable:
    """A stage begins once its predecessor's result is written, so what the predecessor wrote on the way goes first."""
    @wraps(work)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables.release(spark, "pipeline")
        with tables.scope("pipeline"):
            return work(spark, docs, sf_dir)

    return begin


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_quality(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id."""
    return near_dup.keep_one(docs)


@_stage
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the table ``benchmark``."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every document that is left."""
    tables.release(spark, "pipeline")  # what this stage itself writes stays, as its result is not written yet
    return kd_shards.shard(docs, SHARDS)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", clean_of_benchmark), ("mixing", mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
