"""Exact dedup against a minimal perfect hash over historical digests.

The distinct SHA-256 digests of the history are dealt into buckets by
their first bytes.  Each bucket gets a minimal perfect hash: a cascade of
bit arrays in which a digest takes the first level where it meets no
other, its slot being the rank of that bit.  A slot holds the full digest,
the winner's locator and the size of its group.  A document's digest is
looked up in its bucket and compared byte for byte with the slot's; on a
match it repeats the history, otherwise it is no member, and nonmembers
are grouped by themselves.

Without a history the documents up to the median doc_id are taken as the
history of those after it, so the smallest doc_id of a group stays.

Lookups stream through sorted partitions with one bucket's table in memory
at a time; a digest with very many copies is dealt over several tasks.

Defined cases: null text counts as empty; a null doc_id comes after all
others; of wholly equal rows one stays; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Digests of one bucket; its table takes about 60 bytes a digest.
BUCKET = 8192
#: Rows of one digest in one lookup task: at least this, or rows / HOT.
HOT = 2000
LEVELS = 64

TABLE = "bucket int, sizes array<int>, bits binary, digests binary, ids binary, known binary, rows binary, counts binary"
FOUND = "doc_id bigint, row bigint, digest binary, win_id bigint, win_row bigint, n bigint"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces aren't touched."""
    runs = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, level % 3 + 1] ^ (words[:, 0] + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bits, and the slot of each of the distinct 32-byte digests."""
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    left, sizes, bits = np.arange(len(words)), [], []
    slots, before = np.zeros(len(words), np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = len(left) + 1
        at = (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        ranks = np.cumsum(once)
        alone = once[at]
        slots[left[alone]] = before + ranks[at[alone]] - 1
        before += int(ranks[-1])
        sizes.append(size)
        bits.append(once)
        left = left[~alone]
    if len(left):
        raise ValueError("digests are not distinct")
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slots


def look_up(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The only slot in which each digest can be; -1 where there is none."""
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    ranks = np.cumsum(bits)
    slots, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = start + (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = ranks[at[hit]] - 1
        left, start = left[~hit], start + size
    return slots


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32)
    sizes, bits, slots = build(digests)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    known = pdf["win_id"].notna().to_numpy()[order]
    ids = pdf["win_id"].fillna(0).to_numpy().astype(np.int64)[order]
    return pd.DataFrame({
        "bucket": [pdf["bucket"].iloc[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
        "digests": [digests[order].tobytes()], "ids": [ids.tobytes()], "known": [known.tobytes()],
        "rows": [pdf["win_row"].to_numpy()[order].astype(np.int64).tobytes()], "counts": [pdf["n"].to_numpy()[order].astype(np.int64).tobytes()],
    })


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, salt and kind: a bucket's table comes before its documents."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FOUND.split(", "))])
    now = None
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        kind = at["kind"].to_numpy()
        heads = np.flatnonzero(kind == 0)
        for a, b in zip([-1, *heads], [*heads, len(kind)], strict=True):
            if a >= 0:
                sizes = at["sizes"][a].as_py()
                bits = np.unpackbits(np.frombuffer(at["bits"][a].as_py(), np.uint8), count=sum(sizes)).astype(bool)
                full = np.frombuffer(at["digests"][a].as_py(), np.uint8).reshape(-1, 32)
                now = (sizes, bits, full, *(np.frombuffer(at[k][a].as_py(), t) for k, t in (("ids", np.int64), ("known", bool), ("rows", np.int64), ("counts", np.int64))))
            if b - a <= 1:
                continue
            cut = at["digest"].slice(a + 1, b - a - 1)
            mine = np.frombuffer(b"".join(cut.to_pylist()), np.uint8).reshape(-1, 32)
            if now is None:
                member = np.zeros(len(mine), bool)
                values = [np.zeros(len(mine), np.int64)] * 3
                known = member
            else:
                sizes, bits, full, ids, has, rows, counts = now
                slot = look_up(mine, sizes, bits)
                member = (slot >= 0) & (full[slot] == mine).all(axis=1)
                slot = np.where(member, slot, 0)
                values, known = [ids[slot], rows[slot], counts[slot]], has[slot]
            gone = ~member
            yield pa.RecordBatch.from_arrays([
                at["doc_id"].slice(a + 1, b - a - 1), at["row"].slice(a + 1, b - a - 1), cut.cast(pa.binary()),
                pa.array(values[0], mask=gone | ~known), pa.array(values[1], mask=gone), pa.array(values[2], mask=gone),
            ], schema=schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest.  Rows are numbered when the table is written, once."""
    return written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )


def grouped(rows: DataFrame) -> DataFrame:
    """digest, winner (smallest doc_id, null last, then row), count."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("row").alias("r")))
    return (
        rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("n"))
        .select("digest", F.col("w.i").alias("win_id"), F.col("w.r").alias("win_row"), "n")
    )


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the salt that deals a hot digest's rows over several tasks."""
    salt = F.coalesce(F.pmod(F.hash("doc_id", "row"), F.col("salts")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).drop("salts")


def _hot(rows: DataFrame, n: int) -> DataFrame:
    """digest, salts of digests with more than max(BUCKET, n / HOT) rows: fewer than HOT."""
    limit = max(BUCKET, n // HOT)
    counts = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return counts.select("digest", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def looked_up(rows: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """FOUND of each row: what the slot of its digest holds, nulls for nonmembers of `known`."""
    buckets = max(1, -(-known.count() // BUCKET))
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    tables = known.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_table, TABLE)
    most = hot.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("salts").alias("most"))
    tables = tables.join(F.broadcast(most), "bucket", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("most", F.lit(1)) - 1))
    ).drop("most")
    both = tables.withColumn("kind", F.lit(0)).unionByName(
        _salted(rows, hot).select("doc_id", "row", "digest", bucket.alias("bucket"), "salt", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    return both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(_stream, FOUND)


def _among_themselves(rest: DataFrame, hot: DataFrame) -> DataFrame:
    """FOUND of nonmembers: the winner and size of their own group."""
    groups = grouped(rest).join(F.broadcast(hot), "digest", "left")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return _salted(rest, hot).join(groups, ["digest", "salt"]).select("doc_id", "row", "digest", "win_id", "win_row", "n")


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of `docs`.

    With a `history` (doc_id, text) its members are repeats and none of
    them stays; group_size then counts the historical rows.

    Without one, the rows up to the median doc_id are the history.  It
    holds the winner of each of its digests, being the smaller ids; the
    later rows are looked up, those found are added to the size in the
    digest's slot, and a second lookup answers all members.
    """
    rows = digests(docs)
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", F.lit(0.5))).first()[0]
        early = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("bigint"), F.lit(False))
        old, new = rows.where(early), rows.where(~early)
    else:
        old, new = digests(history), rows
    hot = written(_hot(rows, rows.count()), "digest-hot")
    known = written(grouped(old), "digest-groups")
    found = written(looked_up(new, known, hot), "digest-lookups")
    hits, rest = found.where("n is not null"), found.where("n is null").select("doc_id", "row", "digest")
    if history is None:
        more = hits.groupBy("digest").agg(F.count("*").alias("more"))
        total = known.join(more, "digest", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("more")
        total = written(total, "digest-totals")
        forget(known)
        hits = looked_up(old.unionByName(hits.select("doc_id", "row", "digest")), total, hot)
    stays = F.col("row") == F.col("win_row")
    last = lambda df, kept: df.select("doc_id", F.col("win_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")
    return last(hits, stays if history is None else F.lit(False)).unionByName(last(_among_themselves(rest, hot), stays))


def op8(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
with d as (select doc_id, row_number() over () as row,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by doc_id nulls last, row)
"""
