"""Predicates on samples, and checks of whole vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INFINITE = (float("inf"), float("-inf"))


def found(x: Column, kind: str, value: float | None = None, w: WindowSpec | None = None) -> Column:
    """Whether a sample is one that `kind` looks for; false, never NULL.

    Comparisons see missing values as not matching.  SameAsPrevious and
    DifferentFromPrevious compare with the sample before within `w` and
    skip the first; a missing value differs from everything.
    """
    infinite = F.coalesce(x.isin(*INFINITE), F.lit(False))
    if kind in ("SameAsPrevious", "DifferentFromPrevious"):
        same = F.coalesce(x == F.lag(x).over(w), F.lit(False))
        return same if kind == "SameAsPrevious" else ~same & (F.row_number().over(w) > 1)
    tests = {
        "BiggerThan": lambda: x > value, "SmallerThan": lambda: x < value,
        "BiggerOrEqual": lambda: x >= value, "SmallerOrEqual": lambda: x <= value,
        "Equal": lambda: x == value, "NotEqual": lambda: x != value,
        "NaN": x.isNull, "NotNaN": x.isNotNull,
        "Inf": lambda: infinite, "NotInf": lambda: ~infinite,
    }
    return F.coalesce(tests[kind](), F.lit(False))


def contains_bad(x: Column) -> Column:
    return F.bool_or(x.isNull())


def all_missing(x: Column) -> Column:
    return F.bool_and(x.isNull())


def all_value(x: Column, value: float) -> Column:
    return F.bool_and(F.coalesce(x == value, F.lit(False)))


def constant(x: Column) -> Column:
    """All values equal; missing ones equal each other."""
    return (F.min(x).eqNullSafe(F.max(x))) & ((F.count(x) == F.count(F.lit(1))) | (F.count(x) == 0))


def all_equal(a: Column, b: Column) -> Column:
    """Two vectors equal in every sample; a missing value equals nothing."""
    return F.bool_and(F.coalesce(a == b, F.lit(False)))
