"""Signal generators: grids and signals as expressions of the position k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = "2010-01-01 00:00:00"


def grid(spark: SparkSession, n: int, step_s: float = 1.0, start: str = START, series: str = "s") -> DataFrame:
    """series_id, k, ts: n times at a fixed distance."""
    return spark.range(n).select(F.lit(series).alias("series_id"), F.col("id").alias("k"), time_at(F.col("id"), step_s, start).alias("ts"))


def time_at(k: Column, step_s: float = 1.0, start: str = START) -> Column:
    """The time of position k on a grid."""
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * step_s).cast("decimal(18,6)"))


def step(k: Column, at: int, first: float, then: float) -> Column:
    """`first` up to and with position `at`."""
    return F.when(k <= at, F.lit(float(first))).otherwise(F.lit(float(then)))


def two_steps(k: Column, at1: int, at2: int, a: float, b: float, c: float) -> Column:
    """The second switch comes with position at2 - 1."""
    return F.when(k <= at1, F.lit(float(a))).when(k < at2, F.lit(float(b))).otherwise(F.lit(float(c)))


def three_steps(k: Column, at1: int, at2: int, at3: int, a: float, b: float, c: float, d: float) -> Column:
    return F.when(k <= at1, F.lit(float(a))).when(k < at2, F.lit(float(b))).when(k < at3, F.lit(float(c))).otherwise(F.lit(float(d)))


def ramp(k: Column, n: int, a: float, b: float, before: int = 0) -> Column:
    """From a to b in n samples, both included, after `before` samples of a; then b."""
    share = F.least(F.greatest((k - before) / F.lit(float(max(1, n - 1))), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(a)) + share * (b - a)


def sinus(k: Column, amplitude: float, period_s: float, step_s: float = 1.0) -> Column:
    return F.sin(k * (2 * math.pi * step_s / period_s)) * amplitude


def noise(k: Column, amplitude: float, seed: int = 0) -> Column:
    """Uniform in [-amplitude, amplitude), the same for a position and seed on any partitioning: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", k.cast("bigint"), F.lit(seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") * 2.0**-51 - 1.0) * amplitude


def walk_step(k: Column, amplitude: float, start: float = 0.0, seed: int = 0) -> Column:
    """What a random walk adds at position k; ``ordered.running_sum`` adds them up."""
    return F.when(k > 0, noise(k, amplitude, seed)).otherwise(F.lit(float(start)))


def random_walk(k: Column, amplitude: float, start: float = 0.0, seed: int = 0) -> Column:
    """Sum of uniform steps within the series; the first sample is `start`."""
    w = Window.partitionBy("series_id").orderBy("k")
    return F.sum(walk_step(k, amplitude, start, seed)).over(w)
