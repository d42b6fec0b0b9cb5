"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, divergence, exact_dedup, language_id, line_dedup, mixing, near_dedup, quality, secrets, sharding, token_counts, url_filters, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.op1(table(s, d, "documents")),
        "op2_language_id": lambda s, d: language_id.op2(table(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontaminate.op3(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_mix_sources": lambda s, d: mixing.op4(table(s, d, "documents")),
        "op5_secret_scan": lambda s, d: secrets.op5(table(s, d, "documents")),
        "op6_label_shards": lambda s, d: sharding.op6(table(s, d, "documents")),
        "op7_near_dedup": lambda s, d: near_dedup.op7(table(s, d, "documents")),
        "op8_exact_dedup": lambda s, d: exact_dedup.op8(table(s, d, "documents")),
        "op9_token_counts": lambda s, d: token_counts.op9(table(s, d, "documents")),
        "op10_url_filters": lambda s, d: url_filters.op10(table(s, d, "pages")),
        "op11_whitening": lambda s, d: whitening.op11(table(s, d, "embeddings")),
        "op12_quality": lambda s, d: quality.op12(table(s, d, "documents"), table(s, d, "labels")),
        "op13_source_divergence": lambda s, d: divergence.op13(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op10_url_filters": url_filters.ORACLE,
        "op13_source_divergence": divergence.ORACLE,
    }
