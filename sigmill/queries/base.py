"""The supplied tables as series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

#: Samples that are made bad, on both sides.
BAD_EVERY = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user, ordered by (ts, event_id); every 97th value is bad."""
    rows = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % BAD_EVERY == 0, F.lit(-9999.0)).otherwise(F.col("value"))
    return series.from_rows(rows, F.col("user_id"), [F.col("ts"), F.col("event_id")], value, F.col("ts"))


#: Common table expression `s` (series_id, k, ts, x), to follow WITH.
EVENTS = f"""s as (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as k, ts,
  case when event_id % {BAD_EVERY} = 0 then null else value end as x from events)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals a and b by supplier, and row keys."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("series_id"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 1000).alias("c"),
    )


PAIRS = "p as (select l_suppkey as series_id, l_orderkey, l_linenumber, l_quantity as a, l_discount as b, l_extendedprice / 1000 as c from lineitem)"


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + 0.0
