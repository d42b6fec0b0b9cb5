"""Regression of series by a tall QR in blocks, and correlations as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tallqr import each, tall_qr

#: Regressors with a smaller range are reported as near constant.
NEAR_CONSTANT = 0.001


#: Singular values below this part of the largest, columns at equal scale, count as 0.
RANK = 1e-9

FIT = "able boolean, n bigint, params array<double>, bias double, rsq double, ci95 array<double>, rank_deficient boolean, near_constant array<int>"


def solve(n: int, origin: np.ndarray, mean: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, ridge: np.ndarray) -> dict:
    """Least squares from the factor R of the centred columns (xs..., y), by singular values.

    `ridge` are the weights of the squared params.  Regressors that depend
    on each other get the smallest params (at equal scale) of all that fit.
    """
    p = len(ridge)
    a, t = np.concatenate([r[:, :p], np.diag(np.sqrt(ridge))]), np.concatenate([r[:, p], np.zeros(p)])
    size = np.linalg.norm(a, axis=0)
    size[size == 0] = 1.0
    u, s, v = np.linalg.svd(a / size, full_matrices=False)
    real = s > RANK * max(s.max(initial=0.0), 1e-300)
    back = (v.T * np.where(real, 1 / np.where(real, s, 1.0), 0.0)) / size[:, None]
    b = back @ (u.T @ t)
    inverse = back @ back.T
    where = origin[:p] + mean[:p]
    bias = (origin[p] - b @ origin[:p]) + (mean[p] - b @ mean[:p])
    sse, sst = float(((r[:, p] - r[:, :p] @ b) ** 2).sum()), float((r[:, p] ** 2).sum())
    spread = np.append(np.diag(inverse), 1 / n + where @ inverse @ where)
    every = np.append(b, bias)
    return {
        "able": bool(np.isfinite(every).all() and np.abs(every).max() > 0), "n": n, "params": b.tolist(), "bias": float(bias),
        "rsq": 100 * (1 - sse / sst) if sst > 0 else 0.0, "ci95": (1.96 * np.sqrt(np.maximum(0, spread) * sse / max(1, n - p - 1))).tolist(),
        "rank_deficient": bool(not real.all()), "near_constant": np.flatnonzero(high[:p] - low[:p] < NEAR_CONSTANT).tolist(),
    }


def regress(df: DataFrame, y: Column, xs: list[Column], ignore: Column | None = None, regularise: list[int] = [], weight: float | None = None) -> DataFrame:  # noqa: B006
    """Fit y to xs and a bias in each series, over the rows that have every value.

    `regularise` lists the regressors that are drawn towards 0; the weight
    is n / 1000 unless given.  A series is read in blocks by any number of
    tasks (see ``tallqr``), and the fit reads one small factor of it.
    """
    rows = df if ignore is None else df.where(~ignore)
    flags = np.array([i in regularise for i in range(len(xs))], float)
    fit = lambda n, *state: solve(n, *state, flags * (n / 1000 if weight is None else weight))
    return each(tall_qr(rows, [*xs, y]), fit, FIT)


def simple_regression(y: Column, x: Column) -> dict[str, Column]:
    """Slope, intercept and R2 as aggregates, all in the JVM."""
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x)}


def gradient(value: Column, seconds: Column, sample_time_s: float = 1.0) -> Column:
    """Slope of the value for each sample time."""
    return F.regr_slope(value, seconds / sample_time_s)


def correlation(a: Column, b: Column) -> Column:
    """Of the rows that have both; NULL where one doesn't vary, at which ``corr`` divides by zero."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b))))


def correlations(df: DataFrame, main: str, others: list[str], ignore: Column | None = None) -> DataFrame:
    """series_id, signal, corr of each signal with `main`, strongest first within a series."""
    rows = df if ignore is None else df.where(~ignore)
    one = rows.groupBy("series_id").agg(*[correlation(F.col(main), F.col(s)).alias(s) for s in others])
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("corr")) for s in others])
    return one.select("series_id", F.inline(pairs)).orderBy("series_id", F.abs("corr").desc_nulls_last(), "signal")


def modelled(df: DataFrame, fits: DataFrame, xs: list[Column]) -> DataFrame:
    """Add y_mod, the fitted value of each row."""
    x = F.array(*xs)
    value = F.aggregate(F.zip_with(x, "params", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("bias")
    return df.join(fits.select("series_id", "params", "bias"), "series_id").withColumn("y_mod", value).drop("params", "bias")
