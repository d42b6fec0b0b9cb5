"""Near duplicates by DartMinHash: classes of texts that share 5-word shingles.

A text is a weighted set: its shingles with their numbers of occurrences.
Darts are thrown by hashes alone.  The region of a shingle's v-th
occurrence meets a Poisson process of darts of rising rank; those up to
rank `darts / weight` are generated, each falls on one coordinate, and a
coordinate keeps its earliest dart.  Two texts keep the same dart with
probability equal to their weighted Jaccard similarity, the sum of the
smaller counts over the sum of the larger ones.

Coordinates are joined in bands.  Candidates are verified exactly on
their texts; a candidate is only set aside unread when its weights, or
all coordinates together, rule out the threshold (five standard errors,
a chance below 3e-7).

1. Texts with equal shingle counts, by a hash of 128 bits, are one node.
2. Nodes that share a band bucket are linked as ``linking`` describes: each
   with the bucket's first, and in buckets that hold several classes after
   that, by a prefix join on shingles (see ``_hidden``).

Bands miss a pair at the threshold with a probability below 1e-6 (see
BANDS); nothing else loses a link.

Defined cases: null text counts as empty; a text without words is in a
class of its own; a text of fewer than five words is one shingle; of
wholly equal rows one stays; null doc_ids come last, doc_ids may be of any
type that has an order; a very long text is hashed in parts; ties between
equal doc_ids go to the smaller hash of the text; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linking
from . import textkernel as K
from .common import arrow_rows, forget, text_tags, written

THRESHOLD = 0.8
#: 36 bands of 5: a pair of similarity 0.8 is missed with probability (1 - 0.8**5)**36 = 6e-7.
BANDS, ROWS = 36, 5
COORDS = BANDS * ROWS
#: Darts expected in a text's region; a coordinate stays empty in 2 % of the texts, which get twice as many.
DARTS = COORDS * (np.log(COORDS) + 4)
#: Pairs whose coordinates agree less often than this are set aside: 0.8 less five standard errors.
LEAST = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / COORDS) ** 0.5
#: Texts signed at once; each has about DARTS darts in memory.
TEXTS = 256
#: Rows of an Arrow batch that holds two texts a row, and bytes compared at once.
PAIRS, PAIR_BYTES = 256, 1 << 20
#: Rows of a narrow side up to which it is broadcast, at 8 bytes a key.
SMALL = 1_000_000

SIGNED = "hi bigint, lo bigint, weight int, bands array<bigint>, coords binary"
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _weighted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: range, sorted (text, shingle) keys, occurrence numbers, first key of each text."""
    data, offsets = K.buffers(column)
    for a, b in K.blocks(offsets, texts=TEXTS):
        cut = offsets[a : b + 1] - offsets[a]
        hashes, _, _, firsts = K.words(data[offsets[a] : offsets[b]], cut)
        found, at = K.grams(hashes, firsts, K.SHINGLE)
        of = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(np.searchsorted(at, firsts)))
        # With fewer than 2**20 texts in a block, 44 bits of the shingle's hash remain.
        keys = np.sort((of << np.uint64(44)) | (found >> np.uint64(20)))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.flatnonzero(new)
        copy = np.arange(len(keys)) - np.repeat(run, np.diff(np.append(run, len(keys))))
        yield a, b, keys, copy, np.searchsorted(keys, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(44))


def _darts(units: np.ndarray, of: np.ndarray, reach: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest rank and dart of each (text, coordinate); units are hashed occurrences."""
    rank = np.full(n * COORDS, np.inf, np.float32)
    darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, state, mine = np.zeros(len(units)), units, of
    while len(state):
        draw = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        # First by a comparison: most units of a long text have no dart.
        near = np.flatnonzero(at - np.log1p(-draw) <= reach[mine])
        state, mine = state[near], mine[near]
        at = at[near] - np.log1p(-draw[near])
        dart = K.mix(state ^ _STEP)
        slot = mine * COORDS + (dart % np.uint64(COORDS)).astype(np.int64)
        short = at.astype(np.float32)
        np.minimum.at(rank, slot, short)
        darts.append((slot, short, dart))
        state = K.mix(state + _STEP)
    out = np.zeros(n * COORDS, np.uint64)
    for slot, short, dart in darts:
        first = short == rank[slot]
        out[slot[first]] = dart[first]
    return rank, out


def signatures(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: coordinates (texts x COORDS, 0 where no words), weight, 128-bit hash of the counts (texts x 2)."""
    for a, b, keys, copy, firsts in _weighted(column):
        n, weight = b - a, np.diff(firsts)
        of = np.repeat(np.arange(n), weight)
        units = K.mix((keys & np.uint64((1 << 44) - 1)) * np.uint64(0x9E3779B97F4A7C15) + copy.astype(np.uint64) * _STEP)
        full = np.flatnonzero(weight)
        node = np.zeros((n, 2), np.uint64)
        for i, salt in enumerate((0x5555, 0xAAAA) if len(full) else ()):
            node[full, i] = np.add.reduceat(K.mix(units ^ np.uint64(salt)), firsts[full])
        coords = np.zeros((n, COORDS), np.uint64)
        todo, reach = full, DARTS / np.maximum(weight, 1)
        while len(todo):
            pick = np.zeros(n, bool)
            pick[todo] = True
            use = pick[of]
            small = np.cumsum(pick) - 1
            rank, darts = _darts(units[use], small[of[use]], reach[todo], len(todo))
            coords[todo] = darts.reshape(-1, COORDS)
            todo = todo[~np.isfinite(rank).reshape(-1, COORDS).all(axis=1)]
            reach = reach * 2
        yield coords, weight, node


_BAND = K.mix(np.arange(1, COORDS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, tag, tag2, text) -> the first four columns and SIGNED."""
    for batch in batches:
        done = 0
        for coords, weight, node in signatures(batch.column(4)):
            n = len(weight)
            bands = K.mix((coords.reshape(n, BANDS, ROWS) * _BAND).sum(axis=2))
            short = (coords >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).slice(done, n) for i in range(4)), pa.array(node[:, 0].view(np.int64)), pa.array(node[:, 1].view(np.int64)),
                pa.array(weight.astype(np.int32)),
                pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), bands.view(np.int64).ravel()),
                pa.array([r.tobytes() for r in short], pa.binary()),
            ], ["row", "doc_id", "tag", "tag2", "hi", "lo", "weight", "bands", "coords"])
            done += n


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, coordinates of both) -> a, b, share of coordinates that agree."""
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COORDS) for i in (2, 3))
        same = (x == y).mean(axis=1)
        keep = np.flatnonzero(same >= LEAST)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(same[keep])], ["a", "b", "agree"])


def similarity(texts: pa.Array, others: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle counts of each two texts."""
    n, out = len(texts), []
    both = pa.concat_arrays([texts.cast(pa.large_string()), others.cast(pa.large_string())])
    order = np.arange(2 * n).reshape(2, n).T.ravel()
    size = np.add(*(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (texts, others)))
    ends = np.append(0, np.cumsum(size))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PAIR_BYTES, "right")) - 1)
        part = both.take(pa.array(order[2 * start : 2 * stop]))
        start, m = stop, len(part) // 2
        data, offsets = K.buffers(part)
        hashes, _, _, firsts = K.words(data, offsets)
        found, at = K.grams(hashes, firsts, K.SHINGLE)
        of = np.repeat(np.arange(2 * m), np.diff(np.searchsorted(at, firsts)))
        keys, side = found ^ K.mix((of >> 1).astype(np.uint64) + np.uint64(7)), of & 1
        order_ = np.argsort(keys)
        keys, side, pair = keys[order_], side[order_], (of >> 1)[order_]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        right = np.add.reduceat(side, new) if len(keys) else np.zeros(0)
        left = (np.diff(np.append(new, len(keys))) - right) if len(keys) else np.zeros(0)
        small = np.bincount(pair[new], np.minimum(left, right), m) if len(keys) else np.zeros(m)
        large = np.bincount(pair[new], np.maximum(left, right), m) if len(keys) else np.ones(m)
        out.append(small / np.maximum(large, 1))
    return np.concatenate(out) if out else np.zeros(0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sim = similarity(batch.column(2), batch.column(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "sim"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> node, shingle, times."""
    schema = pa.schema([("node", pa.int64()), ("gram", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        data, offsets = K.buffers(batch.column(1))
        for a, b in K.blocks(offsets):
            hashes, _, _, firsts = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found, at = K.grams(hashes, firsts, K.SHINGLE)
            of = np.repeat(nodes[a:b], np.diff(np.searchsorted(at, firsts)))
            order = np.lexsort((found, of))
            found, of = found[order], of[order]
            new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(of))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(of[new]), pa.array(found[new].view(np.int64)), pa.array(times)], schema=schema)


class _Texts:
    """Verifies pairs of nodes on the documents' own texts."""

    def __init__(self, docs: DataFrame, signed: DataFrame) -> None:
        self.docs = docs.select(*text_tags(), "text")
        self.signed = signed

    def of(self, need: DataFrame) -> DataFrame:
        """(node) -> (node, text) in a written table."""
        need = written(self.signed.select(F.col("row").alias("node"), "tag", "tag2").join(need, "node", "left_semi"), "near-needed")
        side = F.broadcast(need) if need.count() <= SMALL else need
        out = written(self.docs.join(side, ["tag", "tag2"]).dropDuplicates(["node"]).select("node", "text"), "near-texts")
        forget(need)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = self.of(need)
        left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        sims = both.mapInArrow(_verify, "a bigint, b bigint, sim double")
        with arrow_rows(self.docs.sparkSession, PAIRS):
            out = written(sims.where(F.col("sim") >= THRESHOLD).select("a", "b"), "near-links")
        forget(texts)
        return out

    def promising(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> (a, b, agree) of the pairs whose weights and coordinates don't rule out the threshold."""
        for c in "ab":
            pairs = pairs.join(self.signed.select(F.col("row").alias(c), F.col("weight").alias(f"w{c}"), F.col("coords").alias(f"s{c}")), c)
        pairs = pairs.where(F.least("wa", "wb") >= THRESHOLD * F.greatest("wa", "wb"))
        return pairs.select("a", "b", "sa", "sb").mapInArrow(_agree, "a bigint, b bigint, agree double")

    def hidden(self, mixed: DataFrame) -> DataFrame:
        """Pairs of different classes that may match, by their rarest shingles.

        Two texts of similarity t share at least t of the larger weight.
        With all shingles in one order, by the number of nodes that have
        them, the first that they share is therefore in both among those
        with at most 1 - t of the weight before them, and what follows it
        in either is at least t / (1 + t) of both weights.  Shingles that
        only one node has come first in the order and are never joined, so
        texts that differ by many edits of their own meet nothing.
        """
        comp = mixed.select("node", "comp").distinct()
        texts = self.of(comp.select("node"))
        with arrow_rows(self.docs.sparkSession, 8 * TEXTS):
            each = written(texts.mapInArrow(_shingles, "node bigint, gram bigint, n int"), "near-shingles")
        forget(texts)
        often = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
        shared = written(each.join(often, "gram"), "near-shared")
        forget(each)
        rows = shared.join(comp, "node").join(self.signed.select(F.col("row").alias("node"), "weight"), "node")
        mine = Window.partitionBy("node")
        upto = F.sum("n").over(mine.orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("rest", F.sum("n").over(mine) - upto + F.col("n"))
        rows = written(rows.where(F.col("rest") >= THRESHOLD * F.col("weight")).select("node", "comp", "gram", "weight", "rest"), "near-prefixes")
        forget(shared)
        x, y = (rows.select("gram", *[F.col(n).alias(f"{n}_{c}") for n in ("node", "comp", "weight", "rest")]) for c in "xy")
        fits = F.least("rest_x", "rest_y") >= (F.col("weight_x") + F.col("weight_y")) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6
        met = x.join(y, "gram").where((F.col("node_x") < F.col("node_y")) & (F.col("comp_x") != F.col("comp_y")) & fits)
        return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the nodes (hi, lo, node, w, n) and (node, comp) of nodes with links.

    A node is the number of its first row in the written table.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *text_tags(), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession, 8 * TEXTS):
        signed = written(rows.mapInArrow(_sign, f"row bigint, doc_id {kind}, tag bigint, tag2 bigint, {SIGNED}"), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tag", "tag2")).alias("w")
    nodes = written(
        signed.where("weight > 0").select("hi", "lo", "row", "doc_id", "tag", "tag2").groupBy("hi", "lo").agg(F.min("row").alias("node"), first, F.count("*").alias("n")),
        "near-nodes",
    )
    firsts = signed.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi")
    keyed = firsts.select("node", F.posexplode("bands").alias("i", "band")).select("node", F.xxhash64("i", "band").alias("band"))
    texts = _Texts(docs, signed)
    return signed, nodes, linking.classes(keyed, texts.promising, texts.links, texts.hidden)


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, tag, tag2, class_id, class_tag, class_tag2, class_size for every row.

    class_id is the class's smallest doc_id, class_tag and class_tag2 the
    hash of its text.
    """
    signed, nodes, comp = classes(docs)
    merged = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = merged.groupBy("comp").agg(F.min("w").alias("w"), F.sum("n").alias("class_size")).where("class_size > 1")
    many = written(merged.select("hi", "lo", "comp").join(whole, "comp").select(
        "hi", "lo", F.col("w.doc_id").alias("class_id"), F.col("w.tag").alias("class_tag"), F.col("w.tag2").alias("class_tag2"), "class_size"
    ), "near-members")
    forget(nodes, comp)
    side = F.broadcast(many) if many.count() <= SMALL else many
    rows = signed.select("doc_id", "tag", "tag2", "lo", F.when(F.col("weight") > 0, F.col("hi")).alias("hi"))
    out = rows.join(side, ["hi", "lo"], "left")
    alone = F.col("class_size").isNull()
    own = lambda c, other: F.when(alone, F.col(c)).otherwise(F.col(other)).alias(other)
    return out.select(
        "doc_id", "tag", "tag2", own("doc_id", "class_id"), own("tag", "class_tag"), own("tag2", "class_tag2"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: one of each class, all columns kept."""
    found = near_classes(docs)
    stays = found["doc_id"].eqNullSafe(found["class_id"]) & (found["tag"] == found["class_tag"]) & (found["tag2"] == found["class_tag2"])
    gone = written(
        found.groupBy("doc_id", "tag", "tag2").agg(F.count("*").alias("n"), F.max("class_size").alias("c"), F.max(stays).alias("stays"))
        .where("not stays or (n > 1 and c > 1)").select(F.struct("doc_id", "tag", "tag2").alias("key"), "stays"),
        "near-gone",
    )
    side = F.broadcast(gone) if gone.count() <= SMALL else gone
    # All of the documents' columns are one column here, so their names can't clash with these.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.struct("doc_id", *text_tags()).alias("key"))
    same = [F.col("l.key.doc_id").eqNullSafe(F.col("r.key.doc_id")), F.col("l.key.tag") == F.col("r.key.tag"), F.col("l.key.tag2") == F.col("r.key.tag2")]
    marked = whole.alias("l").join(side.alias("r"), same, "left").select("l.all", "l.key", "stays")
    rest = marked.where("stays is null").select("all.*")
    # Wholly equal rows of the document that stays: one of them.
    twice = marked.where("stays").groupBy("key").agg(F.first("all").alias("all")).select("all.*")
    return rest.unionByName(twice)


def op7(docs: DataFrame) -> DataFrame:
    return near_classes(docs).select("doc_id", "class_id", "class_size")
