"""Detectors of bad, frozen and oversampled data.  Flags are columns, so they filter and join like data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .ordered import BLOCK, B, carried, haloed, numbered, own, so_far
from .series import W


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def bad(signals: list[str]) -> Column:
    """A sample at which any signal is missing."""
    return any_of([F.col(s).isNull() for s in signals])


def plus_next(flag: Column, w: WindowSpec | None = None) -> Column:
    """The flag, and the sample after it.

    This and the next ones run over the series, or over blocks with a halo
    of one row on both sides.
    """
    return flag | F.coalesce(F.lag(flag).over(w or W()), F.lit(False))


def plus_previous(flag: Column, w: WindowSpec | None = None) -> Column:
    """The flag, and the sample before it; with a flag on the first sample also the second."""
    w = w or W()
    return flag | F.coalesce(F.lead(flag).over(w), F.lit(False)) | (F.coalesce(F.lag(flag).over(w), F.lit(False)) & (F.col("k") == 1))


def frozen(signals: list[str], w: WindowSpec | None = None) -> Column:
    """No signal differs from the sample before; a missing value counts as a change."""
    same = [F.coalesce(F.col(s) == F.lag(s).over(w or W()), F.lit(False)) for s in signals]
    return reduce(lambda a, b: a & b, same) & (F.col("k") > 0)


def ignored(df: DataFrame, signals: list[str], given: Column | None = None, detect_frozen: bool = True, block: int = BLOCK) -> DataFrame:
    """Add `ignore`: given samples with the one before, bad ones with the one after, frozen ones."""
    flags = [plus_next(bad(signals), B())]
    if given is not None:
        flags.append(plus_previous(given, B()))
    if detect_frozen:
        flags.append(frozen(signals, B()))
    return own(haloed(df, 1, 1, block).withColumn("ignore", any_of(flags)), block)


def with_frozen(df: DataFrame, signals: list[str], out: str, block: int = BLOCK) -> DataFrame:
    """Add the flag of ``frozen``."""
    return own(haloed(df, 1, 0, block).withColumn(out, frozen(signals, B())), block)


def frozen_runs(df: DataFrame, signals: list[str], block: int = BLOCK) -> DataFrame:
    """series_id, n_frozen, mean_run (rounded up) and min_run of frozen samples before each change."""
    flagged = with_frozen(df.select("series_id", "k", *signals), signals, "_f", block).withColumn("_change", (~F.col("_f") & (F.col("k") > 0)).cast("int"))
    runs = carried(flagged, {"_t": F.sum("_change")}, {"_t0": F.sum("_t")}, block)
    runs = runs.withColumn("_run", F.coalesce("_t0", F.lit(0)) + F.sum("_change").over(so_far()) - F.col("_change"))
    islands = runs.groupBy("series_id", "_run").agg(F.sum(F.col("_f").cast("int")).alias("length"), F.bool_or(F.col("_change") > 0).alias("closed"))
    return islands.groupBy("series_id").agg(
        F.sum("length").alias("n_frozen"),
        F.ceil(F.coalesce(F.avg(F.when(F.col("closed"), F.col("length"))), F.lit(0.0))).alias("mean_run"),
        F.min(F.when(F.col("closed"), F.col("length"))).alias("min_run"),
    )


def without_frozen(df: DataFrame, signals: list[str], block: int = BLOCK) -> DataFrame:
    """Drop frozen samples of series whose mean and least run are one or more; keep others whole."""
    runs = frozen_runs(df, signals, block).select("series_id", ((F.col("mean_run") >= 1) & (F.col("min_run") >= 1)).alias("_cut"))
    return with_frozen(df, signals, "_f", block).join(runs, "series_id", "left").where(~(F.col("_f") & F.coalesce("_cut", F.lit(False)))).drop("_f", "_cut")


def oversampled_factor(df: DataFrame, signals: list[str], block: int = BLOCK) -> DataFrame:
    """series_id, factor, key: n / (n - repeats) where repeats are evenly spread, else 1 and 0.

    Evenly: the longest run of repeats is one less than the factor rounded
    up, and the two largest distances between repeats differ by less than
    three.  The key is where the first largest distance begins.
    """
    sizes = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    runs = numbered(repeat_runs(df, signals, block), [F.col("first")])
    lengths = runs.groupBy("series_id").agg(F.sum("length").alias("repeats"), F.max("length").alias("longest"))
    # Repeats in a run are 1 apart, those of two runs as far as the runs.
    near = own(haloed(runs, 1, 0, block).withColumn("_end", F.lag("last").over(B())), block)
    gaps = near.select("series_id", F.inline(F.array(
        F.struct((F.col("first") - F.col("_end")).alias("gap"), (F.col("_end") + 1).alias("begin")),
        F.struct(F.when(F.col("length") > 1, F.lit(1).cast("bigint")).alias("gap"), F.when(F.col("length") > 1, F.col("first") + 1).alias("begin")),
    ))).where("gap is not null")
    far = gaps.groupBy("series_id", "gap").agg(F.min("begin").alias("begin"))
    ranked = far.groupBy("series_id").agg(F.max(F.struct("gap", "begin")).alias("top"), F.reverse(F.array_sort(F.collect_set("gap"))).alias("gaps"))
    two = ranked.select("series_id", F.col("top.gap").alias("g1"), F.coalesce(F.get("gaps", F.lit(1)), F.col("top.gap")).alias("g2"), F.col("top.begin").alias("key"))
    out = sizes.join(lengths, "series_id", "left").join(two, "series_id", "left")
    factor = F.col("n") / (F.col("n") - F.coalesce("repeats", F.lit(0)))
    ok = F.coalesce((F.col("repeats") >= 2) & (F.col("longest") + 1 == F.ceil(factor)) & (F.col("g1") - F.col("g2") < 3), F.lit(False))
    return out.select("series_id", F.when(ok, factor).otherwise(F.lit(1.0)).alias("factor"), F.when(ok, F.col("key")).otherwise(F.lit(0)).alias("key"))


def repeat_runs(df: DataFrame, signals: list[str], block: int = BLOCK) -> DataFrame:
    """series_id, first, last, length of each stretch of samples at which no signal differs from the sample before.

    Both ends are found with the neighbours of a block; an end takes the
    last start so far, so a stretch may be longer than blocks are.
    """
    same = [F.coalesce(F.col(s) == F.lag(s).over(B()), F.lit(False)) for s in signals]
    flat = reduce(lambda a, b: a & b, same) & (F.col("k") > 0)
    near = haloed(df.select("series_id", "k", *signals), 2, 1, block).withColumn("_f", flat)
    edges = own(near.withColumns({"_open": ~F.coalesce(F.lag("_f").over(B()), F.lit(False)), "_shut": ~F.coalesce(F.lead("_f").over(B()), F.lit(False))}), block).where("_f")
    first = carried(edges.select("series_id", "k", "_open", "_shut"), {"_start": F.max(F.when(F.col("_open"), F.col("k")))}, {"_before": F.max("_start")}, block)
    start = F.coalesce(F.max(F.when(F.col("_open"), F.col("k"))).over(so_far()), F.col("_before"))
    runs = first.select("series_id", "_shut", start.alias("first"), F.col("k").alias("last")).where("_shut")
    return runs.select("series_id", "first", "last", (F.col("last") - F.col("first") + 1).alias("length"))


def unit_oversampled_factor(df: DataFrame, output: str, inputs: list[str], block: int = BLOCK) -> DataFrame:
    """series_id, factor, key, n_flat: the oversampling of a unit's output and inputs together, with flat stretches set aside.

    A stretch of repeats is flat if it is longer by more than 2 than the
    median stretch of its series; the others come from oversampling.
    Without flat stretches the factor is n / (n - repeats).  With them
    their samples don't count, but for the share of a group that each of
    them covers at its ends: (n - (flat - n_flat f)) / (n - repeats) with f
    the factor without that share.  It holds if it exceeds 1 and the
    longest remaining stretch fits it: one less than the factor rounded
    up; with flat stretches, which cut off parts of groups, from two less
    to one more.  Else the factor is 1 and the key 0.  The key is the
    first sample of the first group.
    """
    runs = repeat_runs(df, [output, *inputs], block)
    middle = runs.groupBy("series_id").agg(F.expr("percentile_disc(0.5) within group (order by length)").alias("_m"))
    told = runs.join(middle.withColumnRenamed("series_id", "_s"), F.col("series_id").eqNullSafe(F.col("_s"))).withColumn("_flat", F.col("length") > F.col("_m") + 2)
    one = told.groupBy(F.col("series_id").alias("_s")).agg(
        F.sum("length").alias("_all"), F.sum(F.when(F.col("_flat"), F.col("length")).otherwise(0)).alias("_gone"), F.count_if("_flat").alias("n_flat"),
        F.max(F.when(~F.col("_flat"), F.col("length"))).alias("_longest"), F.min(F.when(~F.col("_flat"), F.col("first"))).alias("_begin"),
    )
    sizes = df.groupBy("series_id").agg(F.count("*").alias("_n"))
    both = sizes.join(one, F.col("series_id").eqNullSafe(F.col("_s")), "left")
    left = F.col("_n") - F.col("_all")
    plain = (F.col("_n") - F.col("_gone")) / left
    factor = F.when(F.col("n_flat") == 0, plain).otherwise((F.col("_n") - (F.col("_gone") - F.col("n_flat") * plain)) / left)
    sized = both.withColumn("_f", factor)
    fits = F.when(F.col("n_flat") == 0, F.col("_longest") + 1 == F.ceil("_f")).otherwise(F.col("_longest").between(F.floor("_f") - 1, F.ceil("_f") + 1))
    fine = F.coalesce((F.col("_all") >= 2) & (F.col("_f") > 1) & fits, F.lit(False))
    return sized.select(
        "series_id", F.when(fine, F.col("_f")).otherwise(1.0).alias("factor"), F.when(fine, F.col("_begin") - 1).otherwise(0).alias("key"), F.coalesce("n_flat", F.lit(0)).alias("n_flat")
    )


def outside(column: str, low: float | None, high: float | None) -> Column:
    """Values beyond limits; a limit that is None is off."""
    flags = []
    if low is not None:
        flags.append(F.col(column) < low)
    if high is not None:
        flags.append(F.col(column) > high)
    return F.coalesce(any_of(flags), F.lit(False))
