"""Classes of items that share bucket keys and pass a check, without all pairs of a bucket.

1. In each bucket every item is paired with the bucket's smallest.
2. Pairs that pass the check are links; connected items are one class.
3. In buckets that still hold several classes, the items outside the
   largest are paired with one item of the largest.
4. Only buckets that hold several classes after that can hide a link.  For their
   items the caller gives a join that finds every pair of different classes
   that may match.  First the most promising pair of each two classes is
   verified, then every pair whose items are still in different classes.

So no link between two items of one bucket is lost, and a bucket of one
large class costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .graph import components


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, node) in order -> band, node, least of bands with several nodes, and `edge`.

    Rows of the partition's first band are edges, since the band may begin
    before; so is one row of its last band, which may go on.  For edges
    `least` isn't known.
    """
    names = ["band", "node", "least", "edge"]
    first = last = None
    for batch in batches:
        if not len(batch):
            continue
        band, node = (batch.column(i).to_numpy() for i in range(2))
        fresh = np.append(last is None or band[0] != last[0] or node[0] != last[3], (band[1:] != band[:-1]) | (node[1:] != node[:-1]))
        if not fresh.any():
            continue
        band, node = band[fresh], node[fresh]
        if first is None:
            first = band[0]
        new = np.append(last is None or band[0] != last[0], band[1:] != band[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        least = np.where(run >= 0, node[starts][np.maximum(run, 0)] if len(starts) else 0, last[1] if last else 0)
        fresh = band != first
        # A first row is told once its band is seen to go on; the second row tells it.
        second = ~new & np.append(last is not None and last[2] == 1, new[:-1])
        more = fresh & ~new
        lead = fresh & second
        out = [np.concatenate([x[more], y[lead]]) for x, y in ((band, band), (node, least), (least, least))]
        edges = ~fresh
        cols = [np.concatenate([out[0], band[edges]]), np.concatenate([out[1], node[edges]]), np.concatenate([out[2], node[edges]])]
        flags = np.concatenate([np.zeros(len(out[0]), bool), np.ones(edges.sum(), bool)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(flags)], names)
        size = len(band) - starts[-1] if len(starts) else len(band) + (last[2] if last else 0)
        last = (band[-1], least[-1], int(size), node[-1])
    if last is not None and last[0] != first:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([last[1]]), pa.array([True])], names)


def buckets(keyed: DataFrame) -> DataFrame:
    """(band, node) -> band, node, least of the bands that several nodes have.

    One shuffle by ranges of (band, node), so that even a band with very
    many nodes is dealt over tasks; only bands at the ends of ranges are
    grouped once more.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.select("band", "node").repartitionByRange(parts, "band", "node").sortWithinPartitions("band", "node")
    told = written(ranged.mapInArrow(_runs, "band bigint, node bigint, least bigint, edge boolean"), "link-runs")
    edges = told.where("edge").select("band", "node")
    whole = written(edges.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("band", "least"), "link-edges")
    out = written(told.where("not edge").select("band", "node", "least").unionByName(edges.join(whole, "band")), "link-buckets")
    forget(told, whole)
    return out


def classes(
    keyed: DataFrame, promising: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame],
    hidden: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(node, band) -> (node, comp) of the nodes that have links.

    `promising` turns (a, b) into (a, b, agree), leaving out pairs that
    can't match; `links` keeps those of (a, b) that do, in a written table.
    `hidden` turns (band, node, comp), the buckets of several classes, into
    pairs (a, b) of different classes, a < b, repeats allowed.
    """
    met = buckets(keyed)
    star = met.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(promising(star), "link-star")
    found = links(tried.select("a", "b"))
    comp = components(found)
    forget(found)
    mixed = _mixed(met, comp)
    pairs = mixed.where("comp != main").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    again = written(promising(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")), "link-star")
    comp = joined(comp, links(again.select("a", "b")))
    forget(mixed)
    mixed = _mixed(met, comp)
    forget(met)
    if mixed.isEmpty():
        return comp
    tried = tried.unionByName(again)
    rest = hidden(mixed.select("band", "node", "comp")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    left = _between(written(promising(rest), "link-hidden"), comp)
    forget(mixed)
    best = left.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b")
    best = written(best, "link-best")
    for last in (False, True):
        if left.isEmpty():
            break
        comp = joined(comp, links(left.select("a", "b") if last else best))
        if not last:
            after = _between(left.join(best, ["a", "b"], "left_anti"), comp)
            forget(left, best)
            left = after
    forget(left)
    return comp


def joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """The classes after more links."""
    if found.isEmpty():
        return comp
    out = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))
    forget(comp, found)
    return out


def _mixed(met: DataFrame, comp: DataFrame) -> DataFrame:
    """band, node, comp, main, pivot of the buckets with several classes; main is the largest, pivot an item of it."""
    placed = written(met.join(comp, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp")), "link-placed")
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"), F.max("node").alias("last"))
    main = sizes.groupBy("band").agg(F.max_by("comp", "n").alias("main"), F.max_by("last", "n").alias("pivot"), F.count("*").alias("classes"))
    out = written(placed.join(main.where("classes > 1").drop("classes"), "band"), "link-mixed")
    forget(placed)
    return out


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different classes, with the classes."""
    for c in "ab":
        side = comp.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
        pairs = pairs.join(side, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    pairs = pairs.where("_a != _b").select("a", "b", "agree", F.least("_a", "_b").alias("ca"), F.greatest("_a", "_b").alias("cb"))
    return written(pairs, "link-left")
