"""Recursive filters and delays.

A filter is a ``Linear``: its recursion is linear in its state.  Tables of
series are filtered by ``linear`` in blocks, which compose; a ``Machine``
runs the same filter sample by sample for streams and simulation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import running_mean

#: Samples of a block; one row holds them.
BLOCK = 4096


def missing(v: float | None, bad: float = -9999.0) -> bool:
    return v is None or math.isnan(v) or v == bad


class Delay:
    """A sample so long before; until there is one, samples pass through."""

    def __init__(self, time_base_s: float, delay_s: float) -> None:
        self.n = math.ceil(delay_s / time_base_s) if delay_s > 0 else 0
        self.kept: list[float] = []

    def step(self, x: float) -> float:
        if not self.n:
            return x
        self.kept.append(x)
        return self.kept.pop(0) if len(self.kept) > self.n else x


class RunningMean:
    def __init__(self, bad: float = -9999.0) -> None:
        self.bad, self.n, self.mean = bad, 0, 0.0

    def step(self, x: float) -> float:
        if not missing(x, self.bad):
            self.n += 1
            self.mean += (x - self.mean) / self.n
        return self.mean


def good_values(x: np.ndarray, ignore: np.ndarray) -> np.ndarray:
    """Ignored samples take the last good one, leading ones the first good one."""
    at = np.where(ignore, -1, np.arange(len(x)))
    at = np.maximum.accumulate(at)
    first = np.flatnonzero(~ignore)
    at[at < 0] = first[0] if len(first) else 0
    return x[at]


def filtered(df: DataFrame, make: Callable[[], Callable[[float], float]], out: str = "y", ignore_missing: bool = True) -> DataFrame:
    """(series_id, k, x) with `out`: a state machine over each series' samples in order.

    For machines that are not linear, as a limited controller; a series is one task.
    """
    schema = df.select("series_id", "k", "x").schema.add(out, "double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = pdf["x"].to_numpy(dtype=float, na_value=np.nan)
        use = good_values(x, np.isnan(x)) if ignore_missing and len(x) else x
        step = make()
        pdf[out] = [step(v) for v in use.tolist()]
        return pdf

    return df.select("series_id", "k", "x").groupBy("series_id").applyInPandas(one, schema)


@dataclass(frozen=True)
class Linear:
    """s' = m s + c x, y = out s + through x; the first `begins` samples set s = start x."""

    m: np.ndarray
    c: np.ndarray
    start: np.ndarray
    out: np.ndarray
    through: float = 0.0
    begins: int = 1

    @cached_property
    def plain(self) -> tuple[list, list, list, list]:
        return self.m.tolist(), self.c.tolist(), self.start.tolist(), self.out.tolist()

    def states(self, x: np.ndarray, first: bool, s0: np.ndarray) -> np.ndarray:
        """States after each sample of a block; an exact scan by doubled steps."""
        if first:
            n = min(self.begins, len(x))
            head = np.outer(x[:n], self.start)
            rest = self.states(x[n:], False, head[-1]) if len(x) > n else head[:0]
            return np.concatenate([head, rest])
        s, power, step = np.outer(x, self.c), self.m, 1
        s[0] += self.m @ s0
        while step < len(x):
            s[step:] = s[step:] + s[:-step] @ power.T
            power, step = power @ power, 2 * step
        return s

    def values(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        return states @ self.out + self.through * x


def lag_share(tc_s: float, step_s: float) -> float:
    """Share of the last output in a first order lag; 0, which turns it off, for time constants under 0.4 steps (fixed rule)."""
    return 1 / (1 + step_s / tc_s) if tc_s > 0 and tc_s >= 0.4 * step_s else 0.0


@lru_cache(1024)
def low_pass_of(tc_s: float, time_base_s: float = 1.0, order: int = 1) -> Linear:
    """The second order's inner state starts at 0, so it has a start-up transient."""
    a = lag_share(tc_s, time_base_s)
    b = 1 - a
    if order == 1:
        return Linear(np.array([[a]]), np.array([b]), np.ones(1), np.ones(1))
    return Linear(np.array([[a, a * b], [0, a]]), np.array([b * b, b]), np.array([1.0, 0]), np.array([1.0, 0]))


def high_pass_of(tc_s: float, time_base_s: float = 1.0, order: int = 1) -> Linear:
    low = low_pass_of(tc_s, time_base_s, order)
    return replace(low, out=-low.out, through=1.0)


def band_pass_of(low_tc_s: float, high_tc_s: float, time_base_s: float = 1.0) -> Linear:
    """x less its low pass and less its high pass."""
    a = np.array([lag_share(low_tc_s, time_base_s), lag_share(high_tc_s, time_base_s)])
    return Linear(np.diag(a), 1 - a, np.ones(2), np.array([-1.0, 1.0]))


@lru_cache(1024)
def second_order_of(tc_s: float, damping: float, time_base_s: float = 1.0) -> Linear:
    """y'' / w^2 + 2 d y' / w + y = x by backward differences; off without damping or time constant.

    The frequency w is 2 / tc up to damping 1, beyond that 2 d / tc (fixed
    rule).  The first two samples force a steady state.
    """
    a1 = a2 = 0.0
    if damping > 0 and tc_s > 0:
        w = 2 * max(1.0, damping) / tc_s
        weight = 1 + 2 * damping * w + w * w * time_base_s
        a1, a2 = (2 + 2 * damping * w) / weight, -1 / weight
    return Linear(np.array([[a1, a2], [1, 0]]), np.array([1 - a1 - a2, 0]), np.ones(2), np.array([1.0, 0]), begins=2)


class Machine:
    """A ``Linear`` sample by sample, for streams and simulation; it starts anew after an output that is no number."""

    def __init__(self, f: Linear | None = None) -> None:
        self.f, self.seen, self.state = f, 0, []

    def step(self, x: float, f: Linear | None = None) -> float:
        """`f`, where given, replaces the filter from now on and keeps its state."""
        self.f = f or self.f
        m, c, start, out = self.f.plain
        if self.seen < self.f.begins or len(self.state) != len(c):
            self.state = [v * x for v in start]
        else:
            self.state = [sum(a * b for a, b in zip(row, self.state, strict=True)) + v * x for row, v in zip(m, c, strict=True)]
        y = sum(a * b for a, b in zip(out, self.state, strict=True)) + self.f.through * x
        self.seen = self.seen + 1 if math.isfinite(y) else 0
        return y


def linear(df: DataFrame, f: Linear, out: str = "y", block: int = BLOCK) -> DataFrame:
    """(series_id, k, x) with `out`: `f` over each series, in blocks of `block` samples.

    A block's last state is linear in the state before it, so a first pass
    takes each block's own part, these are composed along the series (one
    row a block, and only for series of several blocks), and a second pass
    filters every block from its state.  No task holds a whole series.

    `k` counts each series' samples from 0.  A missing sample takes the
    last good one, leading ones the first good one; a series without a
    good sample gives nulls, and an empty table an empty result.
    """
    kind = df.schema["series_id"].dataType.simpleString()
    rows = df.select("series_id", "k", F.when(~F.isnan("x"), F.col("x")).alias("x")).withColumn("_b", F.floor(F.col("k") / block))
    keys = ["series_id", "_b"]
    good = F.when(F.col("x").isNotNull(), F.col("k"))
    ends = rows.groupBy(*keys).agg(F.max_by("x", good).alias("_high"), F.min_by("x", good).alias("_low"))
    whole = Window.partitionBy("series_id").orderBy("_b")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = ends.select(*keys, F.coalesce(F.last("_high", True).over(before), F.first("_low", True).over(after)).alias("_fill"))
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_s"))
    cut = packed.join(fill, keys).select(*keys, F.col("_s.k").alias("k"), F.col("_s.x").alias("x"), "_fill")
    m = len(f.c)

    def used(x: np.ndarray, fill: float | None) -> np.ndarray:
        x = np.array(x, dtype=float)
        at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
        return np.where(at < 0, np.nan if fill is None else fill, x[at])

    def own(batches):
        for pdf in batches:
            got = [f.states(used(x, v), b == 0, np.zeros(m))[-1] for x, v, b in zip(pdf["x"], pdf["_fill"], pdf["_b"], strict=True)]
            yield pd.DataFrame({"series_id": pdf["series_id"], "_b": pdf["_b"], "_n": pdf["x"].map(len), "_own": got})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s, got = pdf.sort_values("_b"), np.zeros(m), []
        for n, own in zip(pdf["_n"].tolist(), pdf["_own"], strict=True):
            got.append(s)
            s = np.linalg.matrix_power(f.m, n) @ s + own
        return pd.DataFrame({"series_id": pdf["series_id"], "_b": pdf["_b"], "_s0": got})

    several = fill.groupBy("series_id").agg(F.max("_b").alias("_last")).where("_last > 0").select("series_id")
    owns = cut.join(several, "series_id", "left_semi").mapInPandas(own, f"series_id {kind}, _b bigint, _n bigint, _own array<double>")
    starts = owns.groupBy("series_id").applyInPandas(chain, f"series_id {kind}, _b bigint, _s0 array<double>")

    def run(batches):
        for pdf in batches:
            got = []
            for x, v, b, s0 in zip(pdf["x"], pdf["_fill"], pdf["_b"], pdf["_s0"], strict=True):
                use = used(x, v)
                got.append(f.values(use, f.states(use, b == 0, np.zeros(m) if s0 is None else np.asarray(s0, float))))
            yield pd.DataFrame({"series_id": pdf["series_id"], "k": pdf["k"], "x": pdf["x"], "_y": got})

    done = cut.join(starts, keys, "left").mapInPandas(run, f"series_id {kind}, k array<bigint>, x array<double>, _y array<double>")
    flat = done.select("series_id", F.inline(F.arrays_zip("k", "x", "_y")))
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return flat.select("series_id", "k", value("x").alias("x"), value("_y").alias(out))


def low_pass(df: DataFrame, tc_s: float, time_base_s: float = 1.0, order: int = 1, block: int = BLOCK) -> DataFrame:
    """(series_id, k, x, y), filtered as ``linear`` does."""
    return linear(df, low_pass_of(tc_s, time_base_s, order), block=block)


def recursive_average(df: DataFrame, out: str = "y", block: int = BLOCK) -> DataFrame:
    """Add the mean of the samples so far; missing ones are left out, and before the first it is 0."""
    return running_mean(df, F.col("x"), out, block)
