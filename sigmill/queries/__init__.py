"""Queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    from . import algebra, files, models, series, vectors

    return vectors.QUERIES | series.QUERIES | models.QUERIES | algebra.QUERIES | files.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
