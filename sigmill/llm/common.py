"""Shared helpers: tables in the shared folder, prefix sums without hot keys."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the contracts define it.
SPACE = r"\x20\x09-\x0D"
#: Folder used only where the session names none, as in local tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: Rows of one range of a global sort, and the most ranges; larger ranges spill.
RANGE = 250_000
MOST_RANGES = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it; a local master may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The copy outlives lost executors; it is removed by ``forget`` or when
    the driver's Hadoop file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _at(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            files, place = _at(t.sparkSession, path)
            files.delete(place, True)


def text_tags(text: str = "text") -> list[Column]:
    """`tag` and `tag2`, 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("tag"), F.xxhash64(F.lit(1), text).alias("tag2")]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of fewer rows and bytes, for rows that are long, while a table is written."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in keys}
    for k, most in keys.items():
        spark.conf.set(k, most)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each table that is written go when it is, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hash32(*cols: Column | str) -> Column:
    """A uniform long in [0, 2**32) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 32)


def ranges(df: DataFrame, order: list[Column], rows: int, name: str) -> DataFrame:
    """`df` range-sorted by `order` and written, with `_range`, the ascending number of each row's range.

    `order` should end in a column that tells equal rows apart, or many
    equal rows make one range.
    """
    n = max(1, min(MOST_RANGES, rows // RANGE + 1))
    sort = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(sort.withColumn("_range", F.spark_partition_id()), name)


def running_total(df: DataFrame, keys: list[str], value: str, rows: int, out: str, order: list[Column]) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one of its key, in `order`.

    Instead of one window per key, which a key with a third of all rows
    would turn into one task, the rows are range-sorted by (`keys`,
    `order`): totals per (key, range) are pre-aggregated, a small window
    over them gives each range's offset, and the row window runs inside
    one key's rows of one range.  Keys must not be null.
    """
    cut = ranges(df, [*map(F.col, keys), *order], rows, "ranges")
    by = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by).agg(F.sum(value).alias("_s"))
        .select(*by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    )
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(offsets, by)
        .withColumn(out, F.col("_o") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_o")
    )
