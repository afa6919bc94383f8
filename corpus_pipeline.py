"""The corpus pipeline: each stage reads all that its predecessor kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
are handled as each operator's module says; all stages but the last return the columns
they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import decontaminate, mixing, near_copies, quality_rules, sharding
from spanforge.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (linked at a Jaccard similarity of
    0.8 of their five-word shingles; SimHash and MinHash propose the pairs): the one with
    the smallest doc_id."""
    return near_copies.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins out documents to the target weights of their sources."""
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles what is left into shards; adds shard and slot."""
    return sharding.shuffle_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: SimHash, random walks and seeded shuffles have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
