"""Multi-signal datasets: joins on time, combining, set and index algebra, long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .ordered import numbered


def join_on_time(a: DataFrame, b: DataFrame, keys: list[str] = ["ts"]) -> DataFrame:  # noqa: B006
    """Samples at times both have, one for each time: of several, that of the least position `k`, then the least row."""

    def one(df: DataFrame) -> DataFrame:
        rest = sorted((c for c in df.columns if c not in keys), key=lambda c: c != "k")
        if not rest:
            return df.distinct()
        least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one"))
        return least.select(*[c if c in keys else F.col("_one")[c].alias(c) for c in df.columns])

    return one(a).join(one(b), keys)


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the signals of b that it lacks, by position."""
    keys = ["series_id", "k"]
    more = [c for c in b.columns if c not in a.columns]
    return a.join(b.select(*keys, *more), keys, "left")


def replaced(df: DataFrame, signal: str, new: DataFrame) -> DataFrame:
    """`signal` with the values of `new` (series_id, k, value), where it has one; `new` holds a position once."""
    values = new.select("series_id", "k", F.col("value").alias("_new"), F.lit(True).alias("_has"))
    out = df.join(values, ["series_id", "k"], "left")
    return out.withColumn(signal, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(signal))).select(*df.columns)


def removed(df: DataFrame, *signals: str) -> DataFrame:
    return df.drop(*signals)


def with_constant(df: DataFrame, **values: float) -> DataFrame:
    return df.withColumns({k: F.lit(float(v)) for k, v in values.items()})


def inverse(flagged: DataFrame, sizes: DataFrame) -> DataFrame:
    """Positions 0 to n - 1 of each series (series_id, n) that aren't flagged (series_id, k)."""
    every = sizes.where("n > 0").select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("k"))
    return every.join(flagged.select("series_id", "k").distinct(), ["series_id", "k"], "left_anti")


def trailing(flagged: DataFrame) -> DataFrame:
    """Flagged positions and those after them."""
    return union(flagged, shift(flagged, 1))


def shift(flagged: DataFrame, by: int) -> DataFrame:
    return flagged.select("series_id", (F.col("k") + by).alias("k")).where("k >= 0")


def positions(df: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """Positions `first` to `last`, both of them, for each series; none where last is less."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (first, last))
    some = df.select("series_id", low.cast("long").alias("_a"), high.cast("long").alias("_b")).distinct().where("_a <= _b")
    return some.select("series_id", F.explode(F.sequence("_a", "_b")).alias("k"))


def last_position(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("series_id").agg(F.max("k").alias("k"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("series_id", "k").union(b.select("series_id", "k")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("series_id", "k").intersect(b.select("series_id", "k"))


def remove(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("series_id", "k").join(b.select("series_id", "k").distinct(), ["series_id", "k"], "left_anti")


def values_at(df: DataFrame, flagged: DataFrame) -> DataFrame:
    return df.join(flagged.select("series_id", "k").distinct(), ["series_id", "k"], "left_semi")


def values_excluding(df: DataFrame, flagged: DataFrame) -> DataFrame:
    return df.join(flagged.select("series_id", "k").distinct(), ["series_id", "k"], "left_anti")


def positions_of(df: DataFrame, values: list[float]) -> DataFrame:
    return df.where(F.col("x").isin(*values)).select("series_id", "k")


def wide(long: DataFrame, signals: list[str]) -> DataFrame:
    """(series_id, ts, signal, x) -> one column for each signal."""
    return long.groupBy("series_id", "ts").pivot("signal", signals).agg(F.first("x", ignorenulls=True))


def long(df: DataFrame, signals: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals])
    return df.select("series_id", "ts", F.inline(pairs))


def unit_dataset(df: DataFrame, y: str, inputs: list[str], setpoint: str | None = None) -> DataFrame:
    """series_id, k, ts, y_meas, y_set, u array."""
    return df.select("series_id", "k", "ts", F.col(y).alias("y_meas"), (F.col(setpoint) if setpoint else F.lit(None).cast("double")).alias("y_set"), F.array(*inputs).alias("u"))


def as_map(df: DataFrame, signals: list[str]) -> DataFrame:
    """series_id, k, values: a map of signal and value."""
    return df.select("series_id", "k", F.create_map(*[c for s in signals for c in (F.lit(s), F.col(s).cast("double"))]).alias("values"))


def rows_after(rows: DataFrame, index: int) -> DataFrame:
    """The rows of a matrix from position `index` on, counted from 0 again."""
    return rows.where(F.col("k") >= index).withColumn("k", F.col("k") - index)


def summary(df: DataFrame, signals: list[str]) -> DataFrame:
    """signal, n, n_missing, low, high: one pass over all signals."""
    aggs = [f(F.col(s)).alias(f"{s}_{n}") for s in signals for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    row = df.agg(F.count(F.lit(1)).alias("_all"), *aggs)
    one = lambda s: F.struct(
        F.lit(s).alias("signal"), F.col(f"{s}_n").alias("n"), (F.col("_all") - F.col(f"{s}_n")).alias("n_missing"),
        F.col(f"{s}_low").cast("double").alias("low"), F.col(f"{s}_high").cast("double").alias("high"),
    )
    return row.select(F.inline(F.array(*map(one, signals))))


def matrix(df: DataFrame, signals: list[str], ignore: Column | None = None) -> DataFrame:
    """series_id, k, row array, without ignored samples."""
    return (df if ignore is None else df.where(~ignore)).select("series_id", "k", F.array(*[F.col(s).cast("double") for s in signals]).alias("row"))


def transposed(rows: DataFrame) -> DataFrame:
    """(series_id, k, row) -> (series_id, i, column): one array for each signal, ordered by k."""
    cells = rows.select("series_id", "k", F.posexplode("row").alias("i", "v"))
    column = F.array_sort(F.collect_list(F.struct("k", "v")))
    return cells.groupBy("series_id", "i").agg(F.transform(column, lambda c: c["v"]).alias("column"))


def times_vector(rows: DataFrame, vector: list[float]) -> DataFrame:
    """(series_id, k, row) -> (series_id, k, y): matrix times vector."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    dot = F.aggregate(F.zip_with("row", v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("series_id", "k", dot.alias("y"))


def times_scalar(rows: DataFrame, factor: float, index: int | None = None) -> DataFrame:
    """Each cell, or those of one signal, times a factor."""
    cell = lambda v, i: v * factor if index is None else F.when(i == index, v * factor).otherwise(v)
    return rows.withColumn("row", F.transform("row", cell))


def times_components(rows: DataFrame, vector: list[float], k: int | None = None) -> DataFrame:
    """Each row, or the one at `k`, times a vector, cell by cell."""
    by = F.zip_with("row", F.array(*[F.lit(float(x)) for x in vector]), lambda a, b: a * b)
    return rows.withColumn("row", by if k is None else F.when(F.col("k") == k, by).otherwise(F.col("row")))


def replace_row(rows: DataFrame, k: int, vector: list[float]) -> DataFrame:
    new = F.array(*[F.lit(float(x)) for x in vector])
    return rows.withColumn("row", F.when(F.col("k") == k, new).otherwise(F.col("row")))


def replace_column(rows: DataFrame, index: int, value: Column) -> DataFrame:
    return rows.withColumn("row", F.transform("row", lambda v, i: F.when(i == index, value).otherwise(v)))


def get_columns(rows: DataFrame, indices: list[int]) -> DataFrame:
    return rows.withColumn("row", F.array(*[F.get("row", F.lit(i)) for i in indices]))


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.groupBy("series_id").agg((F.max("k") + 1).alias("_n"))
    moved = b.join(n, "series_id", "left").withColumn("k", F.col("k") + F.coalesce("_n", F.lit(0))).drop("_n")
    return a.unionByName(moved)


def reachable(edges: DataFrame) -> DataFrame:
    """(a, b) -> all pairs of which b is downstream of a, each once.

    The new pairs of each round are joined with the edges until there are
    none; rounds are as many as the longest path, and cycles end them too.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    found = new = edges
    while not new.isEmpty():
        more = new.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        new = written(more.join(found, ["a", "b"], "left_anti"), "paths")
        found = found.unionByName(new)
    return found


def sorted_values(df: DataFrame, ascending: bool = True) -> DataFrame:
    """series_id, place, k, x: ties by position."""
    order = F.col("x").asc_nulls_last() if ascending else F.col("x").desc_nulls_last()
    return numbered(df.select("series_id", "k", "x"), [order, F.col("k")], "place").select("series_id", "place", "k", "x")
