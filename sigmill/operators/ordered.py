"""Order within series without a task for a whole series: numbers, neighbours, carried values and running sums.

Samples are numbered by a two-level rank.  Rows are sorted by (series,
order) over all tasks and written, so that each task holds a range of a
series; the rows of each series in each range are counted, and a row's
number is its place in its range after the rows of the ranges before.

Windows over numbered samples (series_id, k, ...) run in blocks of samples
instead of series.  A window that looks at a few neighbours gets a halo:
the rows that stand so far before and after a block are copied into it and
dropped afterwards.  A window without end takes what the blocks before
have to give from a table with one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.shared import written

#: Samples of a block.
BLOCK = 65_536
KEYS = ["series_id", "_b"]


def numbered(df: DataFrame, order: list[Column], out: str = "k") -> DataFrame:
    """Add `out`, the place of each row of (series_id, ...) in its series by `order`, from 0.

    Of rows that `order` doesn't tell apart, any may come first.
    """
    sort = [F.col("series_id"), *order]
    cut = written(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # The upper bits of an id are the task, the lower ones the place in it.
    cut = cut.withColumn("_range", F.shiftright("_at", 33))
    parts = cut.groupBy("series_id", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("series_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    moves = parts.select(F.col("series_id").alias("_s"), F.col("_range").alias("_r"), moved.alias("_move"))
    found = cut.join(moves, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return found.withColumn(out, F.col("_at") + F.col("_move")).drop("_at", "_range", "_s", "_r", "_move")


def B() -> WindowSpec:
    """The samples of a block of a series, in order."""
    return Window.partitionBy(*KEYS).orderBy("k")


def haloed(df: DataFrame, back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Add `_b`, the number of a block, and copy the rows up to `back` before and `ahead` after a block into it.

    ``own`` drops the copies again.
    """
    k = F.col("k")
    first, last = F.greatest(F.floor((k - ahead) / block), F.lit(0)), F.floor((k + back) / block)
    return df.withColumn("_b", F.explode(F.sequence(first, last)))


def own(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row once, without `_b`."""
    return df.where(F.col("_b") == F.floor(F.col("k") / block)).drop("_b")


def carried(df: DataFrame, summary: dict[str, Column], before: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add `_b`, and to each row the columns `before`: window expressions over the `summary` of the blocks before its own.

    `summary` are aggregates of a block's rows, and `before` refers to
    their names; the window ends at the block before.
    """
    cut = df.withColumn("_b", F.floor(F.col("k") / block))
    w = Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*KEYS).agg(*[c.alias(n) for n, c in summary.items()])
    ends = blocks.select(F.col("series_id").alias("_s"), F.col("_b").alias("_c"), *[c.over(w).alias(n) for n, c in before.items()])
    return cut.join(ends, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).drop("_s", "_c")


def so_far() -> WindowSpec:
    return B().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def held(df: DataFrame, x: Column, flag: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Add `out`: the last unflagged value that is there; the first sample counts as unflagged."""
    use = df.withColumn("_u", F.when(~flag | (F.col("k") == 0), x))
    have = F.when(F.col("_u").isNotNull(), F.col("k"))
    both = carried(use, {"_end": F.max_by("_u", have)}, {"_old": F.last("_end", True)}, block)
    return both.withColumn(out, F.coalesce(F.last("_u", True).over(so_far()), F.col("_old"))).drop("_b", "_u", "_old")


def running_sum(df: DataFrame, x: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Add `out`: the sum of the samples so far; missing ones count as 0."""
    both = carried(df.withColumn("_u", F.coalesce(x.cast("double"), F.lit(0.0))), {"_t": F.sum("_u")}, {"_t0": F.sum("_t")}, block)
    return both.withColumn(out, F.coalesce("_t0", F.lit(0.0)) + F.sum("_u").over(so_far())).drop("_b", "_u", "_t0")


def running_mean(df: DataFrame, x: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Add `out`: the mean of the samples so far that are there, 0 before the first."""
    use = df.withColumn("_u", x.cast("double"))
    both = carried(use, {"_t": F.sum("_u"), "_n": F.count("_u")}, {"_t0": F.sum("_t"), "_n0": F.sum("_n")}, block)
    total = F.coalesce(F.col("_t0"), F.lit(0.0)) + F.coalesce(F.sum("_u").over(so_far()), F.lit(0.0))
    n = F.coalesce(F.col("_n0"), F.lit(0)) + F.count("_u").over(so_far())
    return both.withColumn(out, F.when(n > 0, total / n).otherwise(0.0)).drop("_b", "_u", "_t0", "_n0")
