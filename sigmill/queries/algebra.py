"""Queries of index algebra, replaced values, cell-wise products and errors of a series against itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reductions as R
from ..operators import dataset as D
from ..operators import series as O
from .base import EVENTS, events, r


def self_errors(spark, d):
    ev = events(spark, d).withColumn("last", F.lag("x").over(O.W()))
    x, last = F.col("x"), F.col("last")
    return ev.groupBy("series_id").agg(r(R.self_square_error(x, last)).alias("square"), r(R.self_abs_error(x, last)).alias("absolute"))


SELF_ERRORS = f"""with {EVENTS}, l as (select series_id, x, lag(x) over (partition by series_id order by k) as p from s)
select series_id, round(avg((x - p) * (x - p)), 6) as square, round(coalesce(avg(abs(x - p)), 0), 6) as absolute from l group by 1"""


def backwards(spark, d):
    return O.reversed_order(events(spark, d)).select("series_id", "k", "ts", r(F.col("x")).alias("x"))


BACKWARDS = f"""with {EVENTS} select series_id, max(k) over (partition by series_id) - k as k, ts, round(x, 6) as x from s"""


def indices(spark, d):
    """Bad positions moved two on, less those up to 20, and the last one of each series."""
    bad = events(spark, d).where("x is null").select("series_id", "k")
    late = D.remove(D.shift(bad, 2), D.positions(bad, 0, 20))
    last = D.last_position(late).withColumnRenamed("k", "last_k")
    return late.join(last, "series_id").select("series_id", "k", "last_k")


INDICES = f"""with {EVENTS} select series_id, k + 2 as k, max(k + 2) over (partition by series_id) as last_k from s where x is null and k + 2 > 20"""


def replacement(spark, d):
    """Bad samples take the number of their position."""
    ev = events(spark, d)
    new = ev.where("x is null").select("series_id", "k", F.col("k").cast("double").alias("value"))
    return D.removed(D.replaced(ev, "x", new), "ts").select("series_id", "k", r(F.col("x")).alias("x"))


REPLACEMENT = f"""with {EVENTS} select series_id, k, round(coalesce(x, k), 6) as x from s"""


def cells(spark, d):
    """Rows (x, k), the first one replaced by (1, 2), times (2, 3)."""
    rows = events(spark, d).select("series_id", "k", F.array("x", F.col("k").cast("double")).alias("row"))
    out = D.times_components(D.replace_row(rows, 0, [1, 2]), [2, 3])
    return out.select("series_id", "k", r(F.get("row", F.lit(0))).alias("a"), r(F.get("row", F.lit(1))).alias("b"))


CELLS = f"""with {EVENTS} select series_id, k, round(case when k = 0 then 2 else 2 * x end, 6) + 0.0 as a, case when k = 0 then 6 else 3 * k end::double as b from s"""

QUERIES = {
    "self_errors": (self_errors, SELF_ERRORS), "series_reversed": (backwards, BACKWARDS), "index_positions": (indices, INDICES),
    "dataset_replace": (replacement, REPLACEMENT), "matrix_cells": (cells, CELLS),
}
