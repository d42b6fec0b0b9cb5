"""Aggregates of samples.  All are partial aggregates: a long series is summed where it lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -1.7976931348623157e308


def mean(x: Column) -> Column:
    """0 when there is no value."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def largest(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(LOWEST))


def smallest(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(-LOWEST))


def first_largest(x: Column, k: Column) -> Column:
    """Position of the first of the largest values, 0 when there is none."""
    return F.coalesce(F.min_by(k, F.when(x.isNotNull(), F.struct(-x, k))), F.lit(0))


def first_smallest(x: Column, k: Column) -> Column:
    return F.coalesce(F.min_by(k, F.when(x.isNotNull(), F.struct(x, k))), F.lit(0))


def span(x: Column) -> Column:
    return F.max(x) - F.min(x)


def variation(x: Column, norm: bool = False) -> Column:
    """Sum of squared deviations, or the population variance."""
    return F.var_pop(x) if norm else F.var_pop(x) * F.count(x)


def covariation(a: Column, b: Column, norm: bool = False) -> Column:
    """Sum of centred products over samples that have both; normalised by count and largest magnitudes."""
    both = F.covar_pop(a, b)
    return both / (F.max(F.abs(a)) * F.max(F.abs(b))) if norm else both * F.count(a + b)


def covariation_of_own(a: Column, b: Column) -> Column:
    """Sum of products over samples that have both, each less the mean of all its own samples."""
    both = a.isNotNull() & b.isNotNull()
    off = (F.avg(F.when(both, a)) - F.avg(a)) * (F.avg(F.when(both, b)) - F.avg(b))
    return (F.covar_pop(a, b) + off) * F.count_if(both)


def after(k: Column, offset: int, x: Column) -> Column:
    """x from position `offset` on: sums of errors leave out the samples before."""
    return F.when(k >= offset, x)


def mean_abs_error(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(F.abs(b - a)), F.lit(0.0))


def square_error(a: Column, b: Column | float, divide: bool = True) -> Column:
    d = (b - a) if isinstance(b, Column) else (a - b)
    return F.avg(d * d) if divide else F.sum(d * d)


def self_square_error(x: Column, last: Column, divide: bool = True) -> Column:
    """Squared steps from one sample to the next; `last` is the lag of x, and steps from or to a missing sample are left out."""
    return square_error(last, x, divide)


def self_abs_error(x: Column, last: Column) -> Column:
    return mean_abs_error(last, x)


def r_squared(model: Column, measured: Column) -> Column:
    """1 - SSE / SStot, where SStot is that of the model around the mean of the measurements.

    Centred sums: sum (m - c)^2 = n var(m) + n (mean m - c)^2.
    """
    both = model.isNotNull() & measured.isNotNull()
    m, y = F.when(both, model), F.when(both, measured)
    around = F.var_pop(m) + (F.avg(m) - F.avg(y)) * (F.avg(m) - F.avg(y))
    return 1 - F.try_divide(F.avg((y - m) * (y - m)), around)


def time_base(seconds: Column) -> Column:
    """Mean spacing in seconds; 0 for two samples or fewer."""
    n = F.count(F.lit(1))
    return F.when(n <= 2, F.lit(0.0)).otherwise((F.max(seconds) - F.min(seconds)) / F.greatest(n - 1, F.lit(1)))
