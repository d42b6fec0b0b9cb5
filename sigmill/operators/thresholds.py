"""Where the gain of a series changes: the best split of its input range, by running moments.

The rows of a series are summed for each level of the input, sorted by
level over all tasks, and their moments are added up along the levels, in
blocks.  The rows up to a level have the running moments of that level,
those above it the rest of the series' total, so both lines and their
residuals at every threshold come from two rows.  Values are taken from
the series' means, so that squares stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK, carried, numbered, so_far

#: Sums over rows: count, u, y, u^2, u y, y^2.
_SUMS = ("n", "u", "y", "uu", "uy", "yy")


def _side(s: dict[str, Column]) -> tuple[Column, Column]:
    """Slope and squared residual of the line through rows with these sums; null where the input doesn't vary."""
    uu, uy, yy = (s[a + b] - s[a] * s[b] / s["n"] for a, b in ("uu", "uy", "yy"))
    vary = uu > 1e-9 * s["n"]
    return F.when(vary, uy / uu), F.when(vary, yy - uy * uy / uu)


def splits(df: DataFrame, u: Column, y: Column, least: int = 3, block: int = BLOCK) -> DataFrame:
    """series_id, k, threshold, n_low, n_high, gain_low, gain_high, sse: every threshold u <= threshold with `least` rows on both sides.

    Rows without u or y are left out.
    """
    rows = df.select("series_id", u.cast("double").alias("_u"), y.cast("double").alias("_y")).where("_u is not null and _y is not null and not isnan(_u) and not isnan(_y)")
    middle = rows.groupBy(F.col("series_id").alias("_s")).agg(F.avg("_u").alias("_mu"), F.avg("_y").alias("_my"))
    near = rows.join(middle, F.col("series_id").eqNullSafe(F.col("_s"))).select("series_id", F.col("_u").alias("level"), (F.col("_u") - F.col("_mu")).alias("_du"), (F.col("_y") - F.col("_my")).alias("_dy"))
    levels = near.groupBy("series_id", "level", "_du").agg(F.count("*").cast("double").alias("n"), F.sum("_dy").alias("y"), F.sum(F.col("_dy") * F.col("_dy")).alias("yy"))
    du = F.col("_du")
    moments = levels.withColumns({"u": F.col("n") * du, "uu": F.col("n") * du * du, "uy": du * F.col("y")}).drop("_du")
    ranked = numbered(moments, [F.col("level")])
    both = carried(ranked, {f"_t{c}": F.sum(c) for c in _SUMS}, {f"_o{c}": F.sum(f"_t{c}") for c in _SUMS}, block)
    running = both.select("series_id", "k", "level", *[(F.coalesce(f"_o{c}", F.lit(0.0)) + F.sum(c).over(so_far())).alias(f"l_{c}") for c in _SUMS])
    total = ranked.groupBy(F.col("series_id").alias("_s")).agg(*[F.sum(c).alias(f"t_{c}") for c in _SUMS])
    whole = running.join(total, F.col("series_id").eqNullSafe(F.col("_s"))).where(F.col("l_n").between(least, F.col("t_n") - least))
    low, high = _side({c: F.col(f"l_{c}") for c in _SUMS}), _side({c: F.col(f"t_{c}") - F.col(f"l_{c}") for c in _SUMS})
    return whole.select(
        "series_id", "k", F.col("level").alias("threshold"), F.col("l_n").cast("bigint").alias("n_low"), (F.col("t_n") - F.col("l_n")).cast("bigint").alias("n_high"),
        low[0].alias("gain_low"), high[0].alias("gain_high"), (low[1] + high[1]).alias("sse"),
    )


def best_split(df: DataFrame, u: Column, y: Column, least: int = 3, block: int = BLOCK) -> DataFrame:
    """series_id, threshold, n_low, n_high, gain_low, gain_high, sse: the split with the least residual, the lowest of equals.

    Residuals are compared to six digits after the point.
    """
    names = ["threshold", "n_low", "n_high", "gain_low", "gain_high", "sse"]
    best = F.min_by(F.struct(*names), F.when(F.col("sse").isNotNull(), F.struct(F.round("sse", 6), F.col("k"))))
    return splits(df, u, y, least, block).groupBy("series_id").agg(best.alias("b")).where("b is not null").select("series_id", *[F.col(f"b.{c}").alias(c) for c in names])
