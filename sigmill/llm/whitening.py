"""Whitening of embeddings by a singular value decomposition of their centred, distributed rows.

Entries are put on a grid of whole numbers, x = floor(64 c) + 1000000, so
that sums over any number of rows are exact.  The fit list is each
distinct x vector once.  Its rows are centred without a rounding error
larger than that of one division, (n x - S) / n with a whole numerator,
and are the rows of an MLlib RowMatrix, whose ``computeSVD`` sums their
d x d products over the cluster and decomposes them.  A singular value s
gives the eigenvalue e = s^2 / n of the covariance with divisor n.  The
total variance does not come from the decomposition: it is the sum of the
exact deviations, sum over dimensions of (n x - S)^2, divided by n^3.

What reaches the driver is bounded by the dimension d alone: d sums, d x d
products and k x k products.  Vectors with many copies are dropped to one
where they are read, before any shuffle.

Defined cases: a row goes if its vector is null or empty or holds a null
or non-finite entry, or one of LARGEST in size or more, whose x isn't
exact; of vectors of several lengths those of the most frequent length
stay (of equally frequent ones the longest).  Repeated rows and null ids
stay; ties between eigenvalues are ordered by the decomposition, alike for
all rows.  A component whose singular value is below RANK times the
largest can't be told from rounding and is left out, so vectors that are
all equal, and an empty table, give an empty result.  A deviation that no
long can hold is null; the total variance counts it all the same.  Columns
other than the id and the vector are not looked at; long texts in them are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import forget, written

#: x = floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Entries must be smaller than this, for their x to be exact.
LARGEST = float(1 << 40)
#: Components of the result, and the least singular value in parts of the largest.
MOST, RANK = 16, 1e-6

Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column whose lists all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _grid(column: pa.Array) -> np.ndarray:
    return np.floor(STEPS * _matrix(column, np.float64)).astype(np.int64) + SHIFT


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector of the rows whose vector is not empty and has finite entries alone."""
    rows = embeddings.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where((F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))


def _summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> list:
    """Sum of `part` over all batches, entry by entry: one row a task, then a sum for each position."""
    exact = kind != "double"

    def run(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            if len(batch):
                here = part(batch)
                total = here if total is None else total + here
        if total is not None:
            values = [Decimal(int(x)) for x in total] if exact else total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(pa.decimal128(38, 0) if exact else pa.float64()))], ["v"])

    entries = df.mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v"))
    return [r[1] for r in sorted(entries.groupBy("pos").agg(F.sum("col")).collect())]


@dataclass
class Whitening:
    """Fit of n distinct vectors: sums by dimension, eigenvalues, unit eigenvectors (d x k), total variance.

    `identity_error` is the largest entry by which the covariance of the
    whitened fit list differs from the identity.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: long where that is enough, else whole numbers of Python."""
        middle = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle, strict=True)]
        far = x - np.array(middle, np.int64)
        if far.size and self.n * (int(np.abs(far).max()) + 1) >= 1 << 62:
            return far.astype(object) * self.n - np.array(rest, object)
        return far * self.n - np.array(rest, np.int64)

    def squares(self, deviations: np.ndarray) -> np.ndarray:
        """Sum of squares of each row's deviations, exact: long where that is enough."""
        largest = int(np.abs(deviations).max()) if deviations.size else 0
        wide = largest * largest * deviations.shape[1] >= 1 << 63
        return ((deviations.astype(object) if wide else deviations) ** 2).sum(axis=1)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def fit(embeddings: DataFrame, k: int = MOST, key: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """Whitening of up to k components of the distinct vectors, None if there are none."""

    def on_grid(batches: Batches) -> Batches:
        yield from (pa.RecordBatch.from_arrays([_lists(_grid(b.column(0)))], ["x"]) for b in batches if len(b))

    rows = usable(embeddings, key, vector).select("vector")
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length:
        return None
    d = length[0]
    rows = rows.where(F.size("vector") == d)
    distinct = written(rows.mapInArrow(on_grid, "x array<bigint>").distinct(), "fit-list")
    # Sums of a batch can't overflow: entries are below 2**47, a batch has far fewer than 2**16 rows; sums of batches are Python's.
    found = _summed(distinct, lambda b: np.append(_matrix(b.column(0), np.int64).sum(axis=0), len(b)).astype(object), "decimal(38,0)")
    n, sums = int(found[-1]), [int(s) for s in found[:-1]]
    start = Whitening(n, sums, np.ones(1), np.ones((d, 1)), 0.0)

    def centred(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([_lists((start.deviations(_matrix(batch.column(0), np.int64)) / n).astype(np.float64))], ["v"])

    matrix = MLUtils.convertVectorColumnsFromML(distinct.mapInArrow(centred, "v array<double>").select(array_to_vector("v").alias("v")), "v")
    squares = _summed(distinct, lambda b: np.array([sum(map(int, start.squares(start.deviations(_matrix(b.column(0), np.int64)))))], object), "decimal(38,0)")
    total = float(Fraction(int(squares[0]), n**3))
    if not total:
        forget(distinct)
        return None
    # All d of them, so that MLlib decomposes with LAPACK: its iterative solver stops at a tolerance of 1e-10.
    svd = RowMatrix(matrix, n, d).computeSVD(d, False, RANK)
    s = svd.s.toArray()[:k]
    vectors = svd.V.toArray()[:, : len(s)]
    # The largest entry is positive, so that reruns agree.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(s))])
    out = Whitening(n, sums, s * s / n, vectors, total)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = out.project(out.deviations(_matrix(batch.column(0), np.int64)))
        return (z.T @ z).ravel()

    # Deviations sum to 0 exactly, so the whitened fit list is centred before it is multiplied.
    covariance = np.array(_summed(distinct, products, "double")).reshape(len(s), -1) / n
    out.identity_error = float(np.abs(covariance - np.eye(len(s))).max())
    forget(distinct)
    return out


def whiten(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, deviation, whitened, explained of each usable row, which need not be of the fit list."""
    kind = embeddings.schema[key].dataType
    names = [("id", kind), ("component", IntegerType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType())]
    schema = StructType([StructField(a, b) for a, b in names])
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d, k = model.vectors.shape
    explained = model.values / model.total

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                far = model.deviations(_grid(part.column(1)))
                squares = pa.array([int(x) if x < 1 << 63 else None for x in model.squares(far)], pa.int64())
                at = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), squares.take(at),
                    pa.array(model.project(far).ravel()), pa.array(np.tile(explained, len(part))),
                ], names=[a for a, _ in names])

    rows = usable(embeddings, key, vector)
    return rows.where(F.size("vector") == d).mapInArrow(run, schema)


def op11(embeddings: DataFrame) -> DataFrame:
    model = fit(embeddings)
    return whiten(embeddings, model).select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
