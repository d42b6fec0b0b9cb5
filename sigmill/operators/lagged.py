"""How signals lag each other: moments at every lag in one pass, from which delays are chosen.

Each block of samples with a halo of the largest lag before it gives, for
each pair of signals and each lag, the number of samples, their means and
their covariances, as aggregates that merge without squares of large
values.  All of a series' delays are then compared in a table of one row
for each lag; no task holds a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK, B, haloed, own
from .regression import correlation

#: Determinants below this part of the variances' product are taken for 0.
SINGULAR = 1e-9


def lagged(df: DataFrame, y: str, xs: list[str], lags: int, block: int = BLOCK) -> DataFrame:
    """series_id, k, signal, lag, y, y1, x: each sample of y with the one before it and each signal so many samples before.

    A null, and what lies before the first sample, is null.
    """
    rows = haloed(df.select("series_id", "k", F.col(y).alias("_y"), *[F.col(x).alias(f"_x{i}") for i, x in enumerate(xs)]), max(lags, 1), block=block)
    late = [F.array(*[F.lag(f"_x{i}", d).over(B()) for d in range(lags + 1)]) for i in range(len(xs))]
    pairs = F.array(*[F.struct(F.lit(x).alias("signal"), v.alias("v")) for x, v in zip(xs, late, strict=True)])
    seen = own(rows.select("series_id", "k", "_b", F.col("_y").alias("y"), F.lag("_y").over(B()).alias("y1"), pairs.alias("p")), block)
    each = seen.select("series_id", "k", "y", "y1", F.inline("p"))
    return each.select("series_id", "k", "signal", "y", "y1", F.posexplode("v").alias("lag", "x"))


def moments(df: DataFrame, y: str, xs: list[str], lags: int, block: int = BLOCK) -> DataFrame:
    """series_id, signal, lag, n, and means (m) and covariances (c) of y, y1 = y[k - 1] and x[k - lag] over the samples that have all three."""
    rows = lagged(df, y, xs, lags, block).where("y is not null and y1 is not null and x is not null")
    pairs = (("y", "y"), ("y", "y1"), ("y", "x"), ("y1", "y1"), ("y1", "x"), ("x", "x"))
    return rows.groupBy("series_id", "signal", "lag").agg(
        F.count("*").alias("n"), *[F.avg(v).alias(f"m_{v}") for v in ("y", "y1", "x")], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]
    )


def fits(table: DataFrame, dt: float = 1.0) -> DataFrame:
    """Add the fit of y[k] = a y[k - 1] + b x[k - lag] + c at each lag of a table of moments.

    rsq (rounded, so that equal fits are ties), gain b / (1 - a) and
    time_constant_s, for which a = 1 / (1 + dt / time_constant_s); null
    where the regressors depend on each other.
    """
    det = F.expr("c_y1_y1 * c_x_x - c_y1_x * c_y1_x")
    fine = det > SINGULAR * F.col("c_y1_y1") * F.col("c_x_x")
    solved = table.withColumns({
        "a": F.when(fine, F.expr("c_y_y1 * c_x_x - c_y_x * c_y1_x") / det), "b": F.when(fine, F.expr("c_y_x * c_y1_y1 - c_y_y1 * c_y1_x") / det),
    })
    rsq = F.when(F.col("c_y_y") > 0, F.expr("(a * c_y_y1 + b * c_y_x) / c_y_y"))
    return solved.withColumns({
        "rsq": F.round(rsq, 9), "gain": F.try_divide(F.col("b"), 1 - F.col("a")),
        "time_constant_s": F.when(F.col("a").between(0, 1) & (F.col("a") < 1), F.col("a") / (1 - F.col("a")) * dt).otherwise(F.when(F.col("a").isNotNull(), 0.0)),
    })


def delays(df: DataFrame, y: str, xs: list[str], lags: int, dt: float = 1.0, block: int = BLOCK) -> DataFrame:
    """series_id, signal, delay_s, time_constant_s, gain, rsq, n: of all lags up to `lags` the one that fits best, the least of equals."""
    best = F.max_by(F.struct("lag", "time_constant_s", "gain", "rsq", "n"), F.when(F.col("rsq").isNotNull(), F.struct("rsq", -F.col("lag"))))
    found = fits(moments(df, y, xs, lags, block), dt).groupBy("series_id", "signal").agg(best.alias("best"))
    return found.select("series_id", "signal", (F.col("best.lag") * dt).alias("delay_s"), *[F.col(f"best.{c}") for c in ("time_constant_s", "gain", "rsq", "n")])


def strongest_shifts(df: DataFrame, main: str, others: list[str], lags: int, dt: float = 1.0, least_corr: float = 0.4, least_rsq: float = 0.1, block: int = BLOCK) -> DataFrame:
    """series_id, signal, corr, time_constant_s, delay_s: correlation of each signal with `main`, and how `main` lags the strong ones.

    Signals that never vary are left out; a lag is given where the
    correlation and the fit reach the least values.
    """
    corr = df.groupBy("series_id").agg(*[correlation(F.col(main), F.col(x)).alias(f"_c{i}") for i, x in enumerate(others)])
    flat: Column = F.array(*[F.struct(F.lit(x).alias("signal"), F.col(f"_c{i}").alias("corr")) for i, x in enumerate(others)])
    strong = corr.select("series_id", F.inline(flat)).where("corr is not null")
    both = strong.join(delays(df, main, others, lags, dt, block), ["series_id", "signal"], "left")
    told = (F.abs("corr") >= least_corr) & (F.col("rsq") >= least_rsq)
    return both.select("series_id", "signal", "corr", F.when(told, F.col("time_constant_s")).alias("time_constant_s"), F.when(told, F.col("delay_s")).alias("delay_s"))
