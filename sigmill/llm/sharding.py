"""Sharding by balanced label propagation (native).

Documents with equal texts are linked.  Every document starts in a shard
that its hash gives.  In each round a join brings each node the label
that most of its neighbours carry, of labels whose shards have room for
all of them; nodes that want to move are admitted in hash order,
neighbours together, up to the target shard's quota, which linked
documents never exceed.  Rounds go on for as long as they leave fewer
pairs of a group and a label; that number falls each time, so they end.  A last pass moves single documents from shards
with too many rows to those with too few, so that counts differ by one at
most.

A node of the propagation is a bundle: the documents of one group that
start in one shard.  They have the same neighbours and the same label, so
they always move alike, and a group has at most one node per shard: no
hub exists, whatever a group's size.  A group too large for a shard is
cut into parts beforehand; there are fewer than 1.2 times as many such
groups as shards.

Defined cases: null texts are linked to nothing and have size 8; null
doc_ids and repeated rows are rows like others; shards may stay empty
when there are fewer rows than shards; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, hash32, running_total, written

SHARDS = 24
#: Share of a shard's rows above which a group is cut into parts.
LARGE = 0.9


def _at(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), index).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tag, shard, slot: counts differ by one at most."""
    text = F.col("text").cast("binary")
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("g"),
            F.xxhash64("doc_id", "text").alias("tag"),
            hash32("doc_id", F.md5(text)).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    n = rows.count()
    capacity = -(-n // shards)
    counts = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    # Fewer than shards / LARGE rows, whatever the input: safe to broadcast.
    large = counts.where(F.col("n") > LARGE * capacity).select(
        "g", F.ceil(F.col("n") / (LARGE / 2 * max(1, capacity))).cast("int").alias("parts")
    )
    nodes = (
        rows.join(F.broadcast(large), "g", "left")
        .withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.hash("h"), F.col("parts"))).otherwise(0))
        .withColumn("start", F.pmod("h", F.lit(shards)).cast("int"))
    )
    state = nodes.where("g is not null").groupBy("g", "part", "start").agg(F.count("*").alias("n"))
    group = Window.partitionBy("g", "part")
    state = written(
        state.withColumn("label", F.col("start")).withColumn("all", F.sum("n").over(group)).where("all > 1"), "shard-nodes"
    )
    load = [0] * shards
    for s, k in state.groupBy("label").agg(F.sum("n")).collect():
        load[s] = k
    parts = _labels(state)
    while parts:
        after, load, moved = _round(state, load, n // shards, shards)
        before, parts = parts, _labels(after) if moved else 0
        if moved:
            forget(state)
        state = after
        if parts >= before:
            break
    placed = nodes.join(state.select("g", "part", "start", "label"), ["g", "part", "start"], "left").select(
        "doc_id", "size", "text_crc32", "tag", "h", "row",
        F.coalesce("label", "start").alias("label"), F.col("label").isNull().cast("int").alias("single"),
        F.lit(1).cast("long").alias("one"),
    )
    return _even(written(placed, "shard-labels"), n, shards)


def _labels(state: DataFrame) -> int:
    """Different labels in all groups together: what cut edges come from."""
    return state.select("g", "part", "label").distinct().count()


def _round(state: DataFrame, load: list[int], capacity: int, shards: int) -> tuple[DataFrame, list[int], bool]:
    """Move nodes; `load` counts linked documents, since single ones make room for them."""
    quota = [max(0, capacity - x) for x in load]
    votes = state.groupBy("g", "part", "label").agg(F.sum("n").alias("votes"), F.max("all").alias("all"))
    fits = _at(quota, F.col("label")) >= F.col("all") - F.col("votes")
    best = votes.groupBy("g", "part").agg(
        F.max_by("label", F.struct(fits.alias("fits"), "votes", F.hash("g", "label").alias("tie"))).alias("want")
    )
    wish = written(state.drop("was").join(best, ["g", "part"]).withColumn("h", hash32("g", "part")), "shard-wishes")
    moves = wish.where("want != label").drop("all")
    total = moves.count()
    if not total:
        return state, load, False
    ranked = running_total(moves, ["want"], "n", total, "before", [F.col("h"), F.col("g"), F.col("part"), F.col("start")])
    goes = ranked.where(F.col("before") + F.col("n") <= _at(quota, F.col("want"))).select("g", "part", "start", F.lit(True).alias("go"))
    after = written(
        wish.join(goes, ["g", "part", "start"], "left")
        .select("g", "part", "start", "n", F.when(F.col("go"), F.col("want")).otherwise(F.col("label")).alias("label"), "all", F.when(F.col("go"), F.col("label")).alias("was")),
        "shard-nodes",
    )
    load = list(load)
    for was, now, k in after.where("was is not null").groupBy("was", "label").agg(F.sum("n")).collect():
        load[was] -= k
        load[now] += k
    forget(wish)
    return after, load, True


def _even(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Exact counts: the last rows of full shards, single ones, fill the holes of others."""
    have, grouped = [0] * shards, [0] * shards
    for s, single, k in placed.groupBy("label", "single").agg(F.count("*")).collect():
        have[s] += k
        grouped[s] += 0 if single else k
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    extra = [max(0, h - g) for h, g in zip(have, goal, strict=True)]
    holes = [max(0, g - h) for h, g in zip(have, goal, strict=True)]
    first = [sum(extra[:s]) for s in range(shards)]
    ranked = running_total(placed, ["label", "single"], "one", n, "rank", [F.col("h"), F.col("tag"), F.col("row")])
    rank = F.col("rank") + F.when(F.col("single") == 1, _at(grouped, F.col("label"))).otherwise(0)
    stays = rank < _at(goal, F.col("label"))
    index = rank - _at(goal, F.col("label")) + _at(first, F.col("label"))
    to, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        here = (index >= start) & (index < start + holes[s])
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, index - start + have[s]).otherwise(slot)
        start += holes[s]
    return ranked.select(
        "doc_id", "size", "text_crc32", "tag",
        F.when(stays, F.col("label")).otherwise(to).cast("int").alias("shard"),
        F.when(stays, rank).otherwise(slot).cast("long").alias("slot"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
