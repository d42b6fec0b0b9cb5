"""Connected components by large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, comp): comp is the component's smallest node.

    Each round links every node's larger neighbours to its smallest one,
    then every node and its smaller neighbours to the smallest; a node's
    neighbours are never gathered in one place, only their minimum is.
    Ends when no link changes; the rounds grow with the logarithm of the
    longest path.  A round's tables go when the next one's are written.
    """
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            # Every link now leads from a node to its component's smallest, once.
            ends = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
            out = written(ends, "cc-nodes")
            forget(now)
            return out
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A written side has an exchange of its own, so a hub's rows can be split.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = written(large, "cc-large")
        forget(now, least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a")
        now = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            .where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
            "cc-links",
        )
        forget(large, least)
