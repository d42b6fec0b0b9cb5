"""Controllers in velocity form over recorded measurements.

A sample moves the controller's output: u becomes min(high, max(low, u +
by)), where `by` follows from the errors alone.  Such moves are closed
under composition: one after another they make one move of the same form.
So, as the linear filters do, each block of samples is composed to one
move, the blocks' moves are composed along the series, and every block
then runs from its own first output.  Within a block the moves are
composed by doubled steps, without a loop over samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .ordered import BLOCK, KEYS, B, haloed, own

Moves = tuple[np.ndarray, np.ndarray, np.ndarray]


def move(e, e1, e2, kp: float, ti_s: float, td_s: float, dt: float):
    """By how much a PI(D) controller moves for the errors of this sample and the two before; floats, arrays or columns."""
    out = kp * (e - e1)
    if ti_s:
        out = out + kp * dt / ti_s * e
    if td_s:
        out = out + kp * td_s / dt * (e - 2 * e1 + e2)
    return out


def then(a: Moves, b: Moves) -> Moves:
    """The move a, and b after it: (low, high, by)."""
    clamp = lambda v: np.minimum(b[1], np.maximum(b[0], v + b[2]))
    return clamp(a[0]), clamp(a[1]), a[2] + b[2]


def scanned(moves: Moves) -> Moves:
    """The composition of each move with all before it."""
    low, high, by = (v.astype(float) for v in moves)
    step = 1
    while step < len(by):
        now = then((low[:-step], high[:-step], by[:-step]), (low[step:], high[step:], by[step:]))
        low, high, by = (np.concatenate([v[:step], n]) for v, n in zip((low, high, by), now, strict=True))
        step *= 2
    return low, high, by


def applied(moves: Moves, u: float) -> np.ndarray:
    return np.minimum(moves[1], np.maximum(moves[0], u + moves[2]))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    return (v.values.to_numpy(zero_copy_only=False) for v in column)


def _moves(by: np.ndarray, low: float, high: float) -> Moves:
    """A sample without an error moves nothing, nor is it limited."""
    still = np.isnan(by)
    return np.where(still, -np.inf, low), np.where(still, np.inf, high), np.where(still, 0.0, by)


def controlled(df: DataFrame, by: Column, low: float, high: float, start: float, out: str = "u", block: int = BLOCK) -> DataFrame:
    """(series_id, k) with `out`: the outputs of moves `by`, limited to low and high, from `start` on; a null holds the output."""
    kind = df.schema["series_id"].dataType.simpleString()
    rows = df.select("series_id", "k", F.floor(F.col("k") / block).alias("_b"), F.coalesce(by.cast("double"), F.lit(float("nan"))).alias("_by"))
    packed = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("k", "_by"))).alias("s")).select(*KEYS, F.col("s.k").alias("k"), F.col("s._by").alias("by"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [[float(v[-1]) for v in scanned(_moves(x, low, high))] for x in _lists(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([e[i] for e in ends], pa.float64()) for i in range(3)]], ["series_id", "_b", "low", "high", "by"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, bys = (list(_lists(batch.column(i))) for i in (2, 3, 4))
            got = [np.append(start, applied(scanned(m), start)[:-1]) for m in zip(lows, highs, bys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], ["series_id", "_b", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [applied(scanned(_moves(x, low, high)), u) for x, u in zip(_lists(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], ["series_id", "k", "u"])

    moves = packed.select(*KEYS, "by").mapInArrow(whole, f"series_id {kind}, _b bigint, low double, high double, by double")
    chain = moves.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("_b", "low", "high", "by"))).alias("s"))
    starts = chain.select("series_id", *[F.col(f"s.{c}").alias(c) for c in ("_b", "low", "high", "by")]).mapInArrow(begun, f"series_id {kind}, _b array<bigint>, u array<double>")
    each = starts.select(F.col("series_id").alias("_s"), F.inline(F.arrays_zip(F.col("_b").alias("_c"), F.col("u").alias("_u"))))
    each = each.toDF("_s", "_c", "_u")
    both = packed.join(each, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).select("series_id", "k", "by", "_u")
    done = both.mapInArrow(run, f"series_id {kind}, k array<bigint>, u array<double>")
    return done.select("series_id", F.inline(F.arrays_zip("k", "u"))).toDF("series_id", "k", out)


def pid(df: DataFrame, y: Column, yset: Column, kp: float, ti_s: float, td_s: float = 0.0, dt: float = 1.0, limits: tuple[float, float] = (0.0, 100.0), start: float = 0.0, out: str = "u", block: int = BLOCK) -> DataFrame:
    """(series_id, k) with `out`: a PI(D) controller over recorded measurements and set points.

    Before the first sample the error is 0 and the output `start`.  Where
    either is missing the output is held, and the errors before are those
    of the samples that have both.
    """
    rows = df.select("series_id", "k", (yset - y).alias("_e"))
    good = rows.where(F.col("_e").isNotNull() & ~F.isnan("_e"))
    # The good samples are numbered by themselves, so that the ones before stand next to them.
    ranked = ordered.numbered(good.withColumnRenamed("k", "_k"), [F.col("_k")])
    near = haloed(ranked, 2, 0, block)
    back = lambda n: F.coalesce(F.lag("_e", n).over(B()), F.lit(0.0))
    moves = own(near.withColumn("_by", move(F.col("_e"), back(1), back(2), kp, ti_s, td_s, dt)), block)
    at = moves.select(F.col("series_id").alias("_s"), F.col("_k"), "_by")
    every = rows.join(at, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")), "left")
    return controlled(every.select("series_id", "k", "_by"), F.col("_by"), *limits, start, out, block)
