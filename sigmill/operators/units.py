"""Unit processes over tables: static gains, a lag and a delay, and the disturbance that a process doesn't explain.

The static part is an expression of the inputs, the lag a linear filter in
blocks, the delay a look back by a halo.  No sample is stepped in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import steady_state
from . import ordered, recursive, series
from .ordered import BLOCK, B, haloed, own


def response(
    df: DataFrame, inputs: list[str], gains: list[float], bias: float = 0.0, u0: list[float] | None = None, curvatures: list[float] | None = None, unorm: list[float] | None = None,
    time_constant_s: float = 0.0, delay_s: float = 0.0, damping: float = 0.0, limits: tuple[float | None, float | None] = (None, None), dt: float = 1.0, out: str = "y", block: int = BLOCK,
) -> DataFrame:
    """(series_id, k) with `out`: a unit's output, which starts steady.

    A missing input takes its last value; before all inputs have one, the
    output is that of the first sample that has them.  Until the delay is
    over, samples pass undelayed.
    """
    rows = df.select("series_id", "k", *inputs)
    if len(inputs) > 1:
        for name in inputs:
            rows = ordered.held(rows, F.col(name), F.lit(False), name, block)
    static = rows.select("series_id", "k", steady_state([F.col(c) for c in inputs], bias, gains, u0, curvatures, unorm).alias("x"))
    lag = recursive.second_order_of(time_constant_s, damping, dt) if damping > 0 else recursive.low_pass_of(max(time_constant_s, 0.0), dt)
    inner = recursive.linear(static, lag, "_y", block)
    late = math.ceil(delay_s / dt) if delay_s > 0 else 0
    if late:
        inner = own(haloed(inner, late, 0, block).withColumn("_y", series.delayed(F.col("_y"), late, B())), block)
    y: Column = F.col("_y")
    low, high = limits
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    return inner.select("series_id", "k", y.alias(out))


def disturbance(df: DataFrame, y: str, inputs: list[str], gains: list[float], out: str = "d", block: int = BLOCK, **unit) -> DataFrame:
    """(series_id, k) with `out`: the measured output less the unit's output one sample before, of the same sample for the first.

    A missing measurement takes the last one.  `unit` are the parameters
    of ``response``.
    """
    process = response(df, inputs, gains, out="_p", block=block, **unit)
    before = own(haloed(process, 1, 0, block).withColumn("_p", F.when(F.col("k") == 0, F.col("_p")).otherwise(F.lag("_p").over(B()))), block)
    measured = ordered.held(df.select("series_id", "k", y), F.col(y), F.lit(False), "_m", block)
    at = before.select(F.col("series_id").alias("_s"), F.col("k").alias("_k"), "_p")
    both = measured.join(at, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")))
    return both.select("series_id", "k", (F.col("_m") - F.col("_p")).alias(out))
