"""A tall, thin QR decomposition of each series' rows, in blocks that are merged in a tree.

What least squares needs of a series is its number of rows, the mean of
every column, and the triangular factor R of the rows less their mean.
Blocks of rows give these where they are read.  Two blocks merge without
their rows: the factor of the union is that of both factors stacked on one
row for each block, the distance of its mean from the common mean times
the root of its size.  Products of columns are never formed, so no digits
are lost to squares, and columns are taken from an origin, the first row
of a block, so none are lost to a large offset.

Blocks first merge within groups of FAN tasks, then by series: a series of
any length is many small tasks, and the last one reads one factor for each
FAN tasks.  Factors of many series are decomposed at once, padded with
rows of zeros, which change no factor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of a block, and tasks whose factors merge in one.
ROWS, FAN = 1 << 16, 1024

STATE = "series_id {}, part bigint, n bigint, origin array<double>, mean array<double>, r array<double>, low array<double>, high array<double>"


class States:
    """Factors of several blocks: n, origin, mean less origin (each m wide), R (m x m), least and largest values."""

    def __init__(self, n: np.ndarray, origin: np.ndarray, mean: np.ndarray, r: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.origin, self.mean, self.r, self.low, self.high = n, origin, mean, r, low, high

    @staticmethod
    def of_rows(rows: np.ndarray) -> States:
        return States(np.ones(len(rows), np.int64), rows, np.zeros_like(rows), None, rows, rows)

    def merged(self, starts: np.ndarray) -> States:
        """One state for each run of states; `starts` are the places where runs begin."""
        m, counts = self.origin.shape[1], np.diff(np.append(starts, len(self.n)))
        owner = np.repeat(np.arange(len(starts)), counts)
        origin, n = self.origin[starts], np.add.reduceat(self.n, starts)
        far = (self.origin - origin[owner]) + self.mean
        mean = np.add.reduceat(far * self.n[:, None], starts, axis=0) / n[:, None]
        rows = np.sqrt(self.n)[:, None] * (far - mean[owner])
        if self.r is not None:
            rows = np.concatenate([rows[:, None], self.r], axis=1).reshape(-1, m)
            counts, owner = counts * (m + 1), np.repeat(owner, m + 1)
        return States(n, origin, mean, factors(rows, counts, owner), np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts))

    def batch(self, series: pa.Array, part: np.ndarray) -> pa.RecordBatch:
        m = self.origin.shape[1]
        lists = lambda a, width: pa.ListArray.from_arrays(np.arange(0, a.size + 1, width, dtype=np.int32), a.ravel())
        columns = [series, pa.array(part), pa.array(self.n), lists(self.origin, m), lists(self.mean, m), lists(self.r, m * m), lists(self.low, m), lists(self.high, m)]
        return pa.RecordBatch.from_arrays(columns, ["series_id", "part", "n", "origin", "mean", "r", "low", "high"])

    @staticmethod
    def of_batch(batch: pa.RecordBatch) -> States:
        flat = lambda i: batch.column(i).flatten().to_numpy().reshape(len(batch), -1)
        origin = flat(3)
        m = origin.shape[1]
        return States(batch.column(2).to_numpy(), origin, flat(4), flat(5).reshape(-1, m, m), flat(6), flat(7))


def factors(rows: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """R of each owner's rows; rows of one owner stand together, `counts` of them."""
    m = rows.shape[1]
    out = np.zeros((len(counts), m, m))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.maximum(m, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    for size in np.unique(padded):
        mine = np.flatnonzero(padded == size)
        number = np.full(len(counts), -1)
        number[mine] = np.arange(len(mine))
        use = number[owner] >= 0
        block = np.zeros((len(mine), size, m))
        block[number[owner[use]], place[use]] = rows[use]
        out[mine] = np.linalg.qr(block, mode="r")
    return out


def _codes(column: pa.Array) -> np.ndarray:
    found = column.dictionary_encode().indices.fill_null(-1)
    return found.to_numpy().astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ROWS rows, each with a state for every series in it."""
    part, held, count = TaskContext.get().partitionId(), [], 0

    def emptied() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        series = table.column(0).combine_chunks()
        rows = np.stack([c.to_numpy() for c in table.columns[1:]], axis=1)
        codes = _codes(series)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
        return States.of_rows(rows[order]).merged(starts).batch(series.take(pa.array(order[starts])), np.full(len(starts), part))

    for batch in batches:
        if len(batch):
            held.append(batch)
            count += len(batch)
        if count >= ROWS:
            yield emptied()
            held, count = [], 0
    if held:
        yield emptied()


def _merge(batches: Iterator[pa.RecordBatch], fan: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by series and part: one state for each series and `fan` parts, or for each series."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        codes, parts = _codes(batch.column(0)), batch.column(1).to_numpy()
        groups = parts // fan if fan else np.zeros_like(parts)
        starts = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(groups) != 0)))
        done = States.of_batch(batch).merged(starts).batch(batch.column(0).take(pa.array(starts)), parts[starts])
        # The last group may go on in the next batch.
        last = done.slice(len(done) - 1)
        if len(done) > 1:
            yield done.slice(0, len(done) - 1)
    if last is not None:
        yield last


def tall_qr(df: DataFrame, columns: list[Column]) -> DataFrame:
    """STATE of each series over the rows that have all `columns`: one row a series."""
    schema = STATE.format(df.schema["series_id"].dataType.simpleString())
    rows = df.select("series_id", *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        rows = rows.where(F.col(f"c{i}").isNotNull() & ~F.isnan(f"c{i}"))
    found = rows.mapInArrow(_read, schema)
    near = found.repartition("series_id", F.floor(F.col("part") / FAN)).sortWithinPartitions("series_id", "part").mapInArrow(lambda b: _merge(b, FAN), schema)
    return near.repartition("series_id").sortWithinPartitions("series_id", "part").mapInArrow(lambda b: _merge(b, None), schema)


def each(states: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """solve(n, origin, mean, R, low, high) of each series: rows of series_id and `schema`."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = States.of_batch(batch)
            out = [solve(int(s.n[i]), s.origin[i], s.mean[i], s.r[i], s.low[i], s.high[i]) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], kind) for k, kind in kinds.items()]], ["series_id", *kinds])

    return states.mapInArrow(run, f"series_id {states.schema['series_id'].dataType.simpleString()}, {schema}")
