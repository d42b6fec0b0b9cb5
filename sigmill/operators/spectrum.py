"""Spectra of series by a four-step Fourier transform, and the period of a signal.

A series of N = N1 N2 samples, N the largest power of two that it has, is
dealt by position: sample k goes to column k mod N2.  Each column of N1
samples takes a short transform, its entries are turned by twiddle
factors, and dealt again into rows of N2 entries, which take the second
short transform.  So a long series is about sqrt(N) columns and as many
rows, each a group of its own, instead of one task with N samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK, B, haloed, numbered, own

#: Magnitudes below this part of the sum of absolute samples are rounding.
ROUNDING = 1e-9


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """series_id, n, c, x (a column's samples) -> its transform times the twiddle factors."""
    for batch in batches:
        out = []
        for n, c, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            v = np.fft.fft(x.values.to_numpy(zero_copy_only=False))
            out.append(v * np.exp(-2j * np.pi * c / n * np.arange(len(v))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v.real for v in out], pa.list_(pa.float64())), pa.array([v.imag for v in out], pa.list_(pa.float64()))], ["series_id", "n", "c", "re", "im"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """series_id, n, row, re, im (a row's entries) -> its transform."""
    for batch in batches:
        out = [np.fft.fft(a.values.to_numpy() + 1j * b.values.to_numpy()) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v.real for v in out], pa.list_(pa.float64())), pa.array([v.imag for v in out], pa.list_(pa.float64()))], ["series_id", "n", "row", "re", "im"])


def fourier(df: DataFrame) -> DataFrame:
    """series_id, n, bin, re, im: sum of x exp(-2 pi i bin k / n) over the first n samples, n the largest power of two.

    `k` counts each series' samples from 0.  A missing sample counts as 0.
    """
    kind = df.schema["series_id"].dataType.simpleString()
    rows = df.select("series_id", "k", F.coalesce(F.when(~F.isnan("x"), F.col("x")), F.lit(0.0)).alias("x"))
    bits = F.length(F.bin(F.max("k") + 1)) - 1
    sizes = rows.groupBy(F.col("series_id").alias("_s")).agg(bits.alias("_bits"))
    n, wide = F.expr("shiftleft(1L, _bits)"), F.expr("shiftleft(1L, shiftright(_bits, 1))")
    cut = rows.join(sizes, F.col("series_id").eqNullSafe(F.col("_s"))).withColumns({"n": n, "_w": wide}).where("k < n")
    columns = cut.groupBy("series_id", "n", (F.col("k") % F.col("_w")).alias("c")).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    first = columns.select("series_id", "n", "c", F.col("s.x").alias("x")).mapInArrow(_turned, f"series_id {kind}, n bigint, c bigint, re array<double>, im array<double>")
    entries = first.select("series_id", "n", "c", F.posexplode(F.arrays_zip("re", "im")).alias("row", "v"))
    rows = entries.groupBy("series_id", "n", "row").agg(F.sort_array(F.collect_list(F.struct("c", "v.re", "v.im"))).alias("s"))
    second = rows.select("series_id", "n", F.col("row").cast("bigint").alias("row"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))
    ended = second.mapInArrow(_ended, f"series_id {kind}, n bigint, row bigint, re array<double>, im array<double>")
    flat = ended.select("series_id", "n", "row", F.size("re").alias("_w"), F.posexplode(F.arrays_zip("re", "im")).alias("j", "v"))
    # A row's number counts within the N / N2 entries of a column.
    return flat.select("series_id", "n", (F.col("row") + F.col("j") * F.expr("n div _w")).alias("bin"), "v.re", "v.im")


def periods(df: DataFrame, time_base_s: float = 1.0, gap: float = 0.3, block: int = BLOCK) -> DataFrame:
    """series_id, period_s: the period whose magnitude stands out, NULL where none does.

    Magnitudes of the bins 1 to n / 2 - 1 are sorted from the largest.  The
    first that is followed by one smaller by more than a share `gap` ends
    the peaks, and its bin is the frequency.  There is no period if there
    is no such gap, if more than a share `gap` of all bins come before it,
    or if the bin is the first, a whole period.
    """
    spectrum = fourier(df)
    total = df.groupBy(F.col("series_id").alias("_s")).agg(F.sum(F.abs(F.when(~F.isnan("x"), F.col("x")))).alias("_sum"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    half = spectrum.where("bin > 0 and bin < n / 2").join(total, F.col("series_id").eqNullSafe(F.col("_s")))
    clear = F.when(size > ROUNDING * F.greatest(F.col("_sum"), F.lit(1.0)), size).otherwise(0.0)
    ranked = numbered(half.select("series_id", "n", "bin", clear.alias("m")), [F.desc("m"), F.col("bin")])
    following = own(haloed(ranked, 0, 1, block).withColumn("_next", F.lead("m").over(B())), block)
    ends = following.where(F.col("_next") < (1 - gap) * F.col("m")).groupBy("series_id").agg(F.min_by(F.struct("k", "n", "bin"), "k").alias("e"))
    fine = (F.col("e.k") <= F.floor((F.col("e.n") / 2 - 1) * gap)) & (F.col("e.bin") > 1)
    found = ends.select(F.col("series_id").alias("_s"), F.when(fine, time_base_s * F.col("e.n") / F.col("e.bin")).alias("period_s"))
    every = df.select("series_id").distinct()
    return every.join(found, F.col("series_id").eqNullSafe(F.col("_s")), "left").select("series_id", "period_s")
