"""Corpus pipeline: language ID, near dedup, decontamination, mixing, sharding.

Defined cases, for all stages: a null or empty text, having no letter, goes
in the first stage, and so is never seen by the others; null doc_ids come
last where order matters; of repeated rows one stays after near dedup; ties
go to the smaller doc_id, then to the smaller hash of the text; other
columns are kept until the last stage, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm import decontaminate, language_id, mixing, near_dedup, sharding
from sigmill.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that the network takes for no language, go."""
    return language_id.recognised(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.first_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as the mix serves them, a row per pass."""
    return mixing.mixed_stream(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    return sharding.shard(docs).drop("tag")


STAGES = [
    ("language_id", language),
    ("near_dedup", near),
    ("decontaminate", clean),
    ("mix_sources", mixed),
    ("shard", sharded),
]

#: The learned and the graph stages have no SQL; brute force tests stand in for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
