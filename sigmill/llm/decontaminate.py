"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words (runs of letters and digits, A-Z as a-z; in
scripts without spaces each character is a word).  An item of n words may
be changed by k = n / 5 word edits, so one of fewer than 5 words only
matches exactly.  It is split into
k + 1 pieces; at least one of them survives k edits unchanged, so exact
hits of pieces find every passage within the budget.  The words around
each hit are verified with Myers' bit-parallel distance.

Items reach the executors in blocks of bounded size; every block meets
all documents.

Defined cases: null texts are empty; items without a word match nothing;
repeated items each report; an empty benchmark or table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import myers
from . import textkernel as K
from .common import written

BUDGET = 0.2
#: Items sent to the executors at once.
ITEMS = 20_000

HITS = "doc_id bigint, tag bigint, item_id bigint, distance int, start int, end int"
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
#: First and last code points of scripts without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = (
    (0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each text's first word (n + 1 values)."""
    at = np.flatnonzero(data >= 0xE0)
    size = np.where(data[at] >= 0xF0, 4, 3)
    code = data[at].astype(np.int64) & np.where(size == 4, 7, 15)
    for j in (1, 2, 3):
        more = data[np.minimum(at + j, len(data) - 1)].astype(np.int64) & 63
        code = np.where(j < size, code << 6 | more, code)
    own = np.zeros(len(at), bool)
    for low, high in UNSPACED:
        own |= (code >= low) & (code <= high)
    return K.words(data, offsets, _INSIDE, np.union1d(at[own], (at + size)[own]))


class Pieces:
    """The pieces of a block of items, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET) -> None:
        column = pa.array([t for _, t in items], pa.large_string())
        data, offsets = K.buffers(column)
        hashes, _, _, firsts = words(data, offsets)
        self.items, found = [], {}
        for (item, _), a, b in zip(items, firsts[:-1], firsts[1:], strict=True):
            n = int(b - a)
            if not n:
                continue
            k = int(n * budget)
            part = hashes[a:b]
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(K.grams(part[x:y], np.array([0, y - x]), y - x)[0][0])
                found.setdefault(y - x, {}).setdefault(key, []).append((len(self.items), x))
            symbols = part.tolist()
            self.items.append((item, symbols, myers.masks(symbols), k))
        self.tables = {}
        for size, keys in sorted(found.items()):
            order = np.array(sorted(keys), np.uint64)
            bits = np.zeros(1 << 16, bool)
            bits[(order >> np.uint64(48)).astype(np.int64)] = True
            self.tables[size] = (order, bits, [keys[int(x)] for x in order])

    def hits(self, hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first word of the item if nothing before the piece changed), all pieces."""
        out = []
        for size, (order, bits, owners) in self.tables.items():
            if size > len(hashes):
                continue
            found, at = K.grams(hashes, firsts, size)
            may = np.flatnonzero(bits[(found >> np.uint64(48)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(order, found[may]), len(order) - 1)
            true = order[slot] == found[may]
            for p, s in zip(at[may[true]].tolist(), slot[true].tolist(), strict=True):
                text = int(np.searchsorted(firsts, p, "right")) - 1
                out.extend((text, item, p - x) for item, x in owners[s])
        return out

    def search(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, word after the last) of verified passages."""
        last = None
        for text, item, at in [*sorted(self.hits(hashes, firsts)), (-1, -1, 0)]:
            k, n = (self.items[item][3], len(self.items[item][1])) if item >= 0 else (0, 0)
            low, high = at - k, at + n + k
            if last and (last[0], last[1]) == (text, item) and low <= last[3]:
                last[3] = max(last[3], high)
                continue
            if last:
                yield from self._verified(hashes, firsts, *last)
            last = [text, item, low, high]

    def _verified(self, hashes, firsts, text, item, low, high):
        _, symbols, peq, k = self.items[item]
        a, b = max(low, int(firsts[text])), min(high, int(firsts[text + 1]))
        window = hashes[a:b].tolist()
        scores = myers.ends(peq, len(symbols), window)
        done = 0
        while done < len(scores):
            # The good ends of one passage lie within k of its best one.
            first = next((i for i in range(done, len(scores)) if scores[i] <= k), None)
            if first is None:
                return
            stop = min(len(scores), first + 2 * k + 1)
            best = min(range(first, stop), key=lambda i: (scores[i], i))
            reach = window[max(0, best + 1 - len(symbols) - scores[best]) : best + 1]
            start = best + 1 - len(reach) + myers.start_of(symbols, reach, scores[best])
            yield text, item, scores[best], a + start, a + best + 1
            done = best + max(1, len(symbols) - 2 * k)


def _search(pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            found = []
            for a, b in K.blocks(offsets):
                cut, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                hashes, starts, ends, firsts = words(part, cut)
                for text, item, distance, x, y in p.search(hashes, firsts):
                    points = (part[cut[text] : ends[y - 1]] & 0xC0) != 0x80
                    s = int(points[: starts[x] - cut[text]].sum())
                    found.append((a + text, p.items[item][0], distance, s, int(points.sum())))
            if found:
                of, *rest = zip(*found, strict=True)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:], strict=True))], schema=schema
                )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, tag, item_id, distance, start, end (code points) of each passage within the budget."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-items.count() // ITEMS))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.hash("text", "item_id"), F.lit(blocks)) == k).collect()
        pieces = spark.sparkContext.broadcast(Pieces([tuple(r) for r in block], budget))
        part = rows.mapInArrow(_search(pieces), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    leaks = written(find_leaks(docs, benchmark, budget).select("tag").distinct(), "leaks")
    side = F.broadcast(leaks) if leaks.count() <= 1_000_000 else leaks
    # A document with the same text leaks as well, so the text's hash decides.
    return docs.withColumn("tag_", F.coalesce(F.xxhash64("text"), F.lit(0))).join(side.withColumnRenamed("tag", "tag_"), "tag_", "left_anti").select(*docs.columns)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).drop("tag")
