"""Series of samples: rows (series_id, k, ts, x), ordered by k within a series.

Windows are partitioned by series, so many series run in parallel.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import BAD, clean
from . import ordered
from .ordered import BLOCK, B, haloed, numbered, own


def W() -> WindowSpec:
    """All samples of a series, in order."""
    return Window.partitionBy("series_id").orderBy("k")


def from_rows(rows: DataFrame, key: Column, order: list[Column], value: Column, ts: Column, bad: float = BAD) -> DataFrame:
    """Number the samples of each key in order, and turn bad values into NULL."""
    places = [f"_o{i}" for i in range(len(order))]
    named = rows.select(key.alias("series_id"), ts.alias("ts"), clean(value, bad).alias("x"), *[c.alias(p) for c, p in zip(order, places, strict=True)])
    return numbered(named, [F.col(p) for p in places]).select("series_id", "k", "ts", "x")


def moving_average(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last n samples with this one; fewer at the start.  A missing sample makes it missing.

    This and the next ones run over the series, or over blocks of it that
    have a halo (``ordered.haloed``) as wide as they look.
    """
    w = (w or W()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), F.avg(x).over(w))


def smooth(x: Column, kernel: int, w: WindowSpec | None = None) -> Column:
    """Mean of the samples at most `kernel` away that are there; the ends are copied."""
    if kernel <= 0:
        return x
    w = w or W()
    follow = F.count(F.lit(1)).over(w.rowsBetween(1, kernel))
    return F.when((F.col("k") < kernel) | (follow < kernel), x).otherwise(F.avg(x).over(w.rowsBetween(-kernel, kernel)))


def difference(x: Column, w: WindowSpec | None = None) -> Column:
    """x[k] - x[k - 1]; 0 for the first sample."""
    return F.when(F.col("k") == 0, F.lit(0.0)).otherwise(x - F.lag(x).over(w or W()))


def delayed(x: Column, samples: int, w: WindowSpec | None = None) -> Column:
    """The sample so many before; the first ones pass through."""
    return F.when(F.col("k") < samples, x).otherwise(F.lag(x, samples).over(w or W())) if samples > 0 else x


def held(x: Column, flag: Column) -> Column:
    """Flagged samples take the last unflagged value; the first sample stays.  ``ordered.held`` does so in blocks."""
    return F.last(F.when(~flag | (F.col("k") == 0), x), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))


def downsample(df: DataFrame, factor: int, key: int = 0) -> DataFrame:
    """Samples at key, key + factor and so on."""
    return df if factor <= 1 else df.where((F.col("k") >= key) & ((F.col("k") - key) % factor == 0))


def downsample_good(df: DataFrame, factor: int, ignore: Column) -> DataFrame:
    """One sample of each block of `factor`: the last good one up to the block's sample.

    Blocks begin after the first good sample of the first `factor`; a
    block without a good sample keeps its own one, flagged.  Returns
    series_id, block, k, x, flagged.
    """
    flags = df.withColumn("_bad", ignore)
    key = F.min(F.when(~F.col("_bad") & (F.col("k") < factor), F.col("k")))
    ends = flags.groupBy(F.col("series_id").alias("_s")).agg(F.coalesce(key, F.lit(factor - 1)).alias("_key"), F.max("k").alias("_last"))
    keyed = flags.join(ends, F.col("series_id").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = keyed.withColumn("block", F.ceil((F.col("k") - F.col("_key")) / factor)).withColumn("_at", F.col("_key") + F.col("block") * factor)
    blocks = blocks.where("block >= 0 and _at <= _last and (block > 0 or k = _key)")
    pick = F.max_by(F.struct("k", "x"), F.when(~F.col("_bad"), F.col("k")))
    own = F.max_by(F.struct("k", "x"), F.col("k"))
    out = blocks.groupBy("series_id", "block").agg(pick.alias("good"), own.alias("own"))
    at = F.coalesce("good", "own")
    return out.select("series_id", "block", at["k"].alias("k"), at["x"].alias("x"), F.col("good").isNull().alias("flagged"))


def oversample(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Zero-order hold: each grid time (series_id, ts) takes the last sample at or before it."""
    both = df.select("series_id", "ts", "k", "x", F.lit(0).alias("_g")).unionByName(
        grid.select("series_id", "ts", F.lit(1).alias("_g")), allowMissingColumns=True
    )
    w = Window.partitionBy("series_id").orderBy("ts", "_g", "k").rowsBetween(Window.unboundedPreceding, 0)
    got = F.last(F.when(F.col("_g") == 0, F.struct("k", "x")), ignorenulls=True).over(w)
    return both.withColumn("_v", got).where("_g = 1").select("series_id", "ts", F.col("_v.k").alias("k"), F.col("_v.x").alias("x"))


def next_hold(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Each grid time takes the first sample at or after it, and the last sample beyond the end."""
    both = df.select("series_id", "ts", "k", "x", F.lit(1).alias("_g")).unionByName(
        grid.select("series_id", "ts", F.lit(0).alias("_g")), allowMissingColumns=True
    )
    order = Window.partitionBy("series_id").orderBy("ts", "_g", F.col("k").desc_nulls_first())
    sample = F.when(F.col("_g") == 1, F.struct("k", "x"))
    after = F.first(sample, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(sample, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_v", F.coalesce(after, before)).where("_g = 0").select("series_id", "ts", F.col("_v.k").alias("k"), F.col("_v.x").alias("x"))


def on_grid(df: DataFrame, start: datetime, end: datetime, step: timedelta, block: int = BLOCK) -> DataFrame:
    """series_id, ts, k_before, x_before, k_after at the times start, start + step and so on up to `end`.

    Before is the last sample at or before a time, NULL before the first;
    after is the first at or after it, the last sample beyond the end.
    Each sample makes the times from its own up to its successor's, so a
    grid is never joined with the series.  `k` is to follow `ts`.
    """
    w, us = B(), step // timedelta(microseconds=1)
    near = haloed(df.select("series_id", "k", F.col("ts").cast("timestamp_ntz").alias("ts"), "x"), 1, 1, block)
    seen = own(near.withColumns({
        "_next": F.lead("ts").over(w), "_new": F.when((F.col("k") == 0) | (F.lag("ts").over(w) < F.col("ts")), F.col("k")),
    }), block)
    # Of samples at one time the first is `after` it and the last is `before`.
    rows = ordered.held(seen, F.col("_new"), F.col("_new").isNull(), "_first", block)
    after = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{start}', {c})") / F.lit(us)
    low = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.greatest(F.ceil(after("ts")), F.lit(0)))
    most = F.lit((end - start) // step)
    high = F.least(F.when(F.col("_next").isNull(), most).otherwise(F.ceil(after("_next")) - 1), most)
    times = F.when(low <= high, F.sequence(low, high))
    grid = rows.withColumn("_j", F.explode(times)).withColumn("_t", F.expr(f"timestampadd(MICROSECOND, _j * {us}, timestamp_ntz'{start}')"))
    early, level = F.col("_t") < F.col("ts"), F.col("_t") == F.col("ts")
    return grid.select(
        "series_id", F.col("_t").alias("ts"), F.when(~early, F.col("k")).alias("k_before"), F.when(~early, F.col("x")).alias("x_before"),
        F.when(early | level, F.col("_first")).when(F.col("_next").isNull(), F.col("k")).otherwise(F.col("k") + 1).alias("k_after"),
    )


def subset(df: DataFrame, start: int, end: int | None) -> DataFrame:
    """Samples from start to end, both included; a missing or too large end is the last."""
    df = df.where(F.col("k") >= max(0, start))
    return df if end is None else df.where(F.col("k") <= end)


def subset_percent(df: DataFrame, low: float, high: float) -> DataFrame:
    """Samples floor(low n / 100) to floor(high n / 100)."""
    low, high = (min(100.0, max(0.0, p)) for p in (low, high))
    n = df.groupBy(F.col("series_id").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, F.col("series_id").eqNullSafe(F.col("_s"))).drop("_s").where((F.col("k") >= F.floor(F.col("_n") * (low / 100))) & (F.col("k") <= F.floor(F.col("_n") * (high / 100)))).drop("_n")


def index_at(df: DataFrame, when: Column, compat: bool = False) -> DataFrame:
    """series_id, k: the last sample at or before a time, 0 before the first."""
    found = F.max(F.when(F.col("ts") <= when, F.col("k")))
    return df.groupBy("series_id").agg(F.greatest(F.coalesce(found - (1 if compat else 0), F.lit(0)), F.lit(0)).alias("k"))


def subset_days(df: DataFrame, now: Column, span: int, back: int) -> DataFrame:
    """Samples of `span` days that end `back` days before `now`."""
    end = now - F.make_dt_interval(F.lit(back))
    return df.where((F.col("ts") >= end - F.make_dt_interval(F.lit(span))) & (F.col("ts") <= end))


def reversed_order(df: DataFrame) -> DataFrame:
    """Samples with their times from last to first; k counts them anew."""
    n = df.groupBy("series_id").agg(F.max("k").alias("_n"))
    return df.join(n, "series_id").withColumn("k", F.col("_n") - F.col("k")).drop("_n")


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's samples after a's, series by series; b's positions are shifted."""
    n = a.groupBy("series_id").agg((F.max("k") + 1).alias("_n"))
    moved = b.join(n, "series_id", "left").withColumn("k", F.col("k") + F.coalesce("_n", F.lit(0))).drop("_n")
    return a.unionByName(moved)


def appended(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of `more` that come after the last time of their series, in order; others are rejected."""
    last = df.groupBy("series_id").agg(F.max("ts").alias("_t"), (F.max("k") + 1).alias("_n"))
    ok = more.join(last, "series_id", "left").where(F.col("_t").isNull() | (F.col("ts") > F.col("_t"))).dropDuplicates(["series_id", "ts"])
    ok = numbered(ok.drop("k"), [F.col("ts")]).withColumn("k", F.col("k") + F.coalesce("_n", F.lit(0)))
    return df.unionByName(ok.select(*df.columns))
