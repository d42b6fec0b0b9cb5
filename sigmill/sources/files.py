"""Signal files: CSV with a time column, cache files, vectors as text, and XY tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import BAD, clean, parse_number, significant
from ..operators.ordered import numbered

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _numbered(rows: DataFrame) -> DataFrame:
    """series_id is the file; k counts its rows in the order of the file."""
    return numbered(rows.withColumns({"series_id": F.input_file_name(), "_line": F.monotonically_increasing_id()}), [F.col("_line")]).drop("_line")


def read_strings(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """All cells as text; columns without a name are dropped, surplus cells ignored."""
    rows = spark.read.option("mode", "PERMISSIVE").csv(path, sep=sep, header=True)
    # A name that was empty comes as _c and its place.
    return rows.select(*[f"`{c}`" for i, c in enumerate(rows.columns) if c.strip() and c != f"_c{i}"])


def read_numbers(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """series_id, k and every column as a double; text and empty cells are NULL."""
    rows = read_strings(spark, path, sep)
    return _numbered(rows).select("series_id", "k", *[parse_number(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def read_series(spark: SparkSession, path: str, sep: str = ";", time_format: str = TIME_FORMAT) -> DataFrame | None:
    """series_id, k, ts and signals; the first column is the time.  None without a signal."""
    rows = read_strings(spark, path, sep)
    time, *signals = rows.columns
    signals = [s for s in signals if s not in ("Time", "time")]
    if not signals:
        return None
    ts = F.try_to_timestamp(F.col(f"`{time}`"), F.lit(time_format)).cast("timestamp_ntz")
    return _numbered(rows).select("series_id", "k", ts.alias("ts"), *[parse_number(F.col(f"`{s}`")).alias(s) for s in signals])


def series_from_text(spark: SparkSession, content: str, sep: str = ";", time_format: str = TIME_FORMAT) -> DataFrame:
    """The same from a text in memory."""
    head = content.split("\n", 1)[0].strip("\r")
    signals = [n for n in head.split(sep)[1:] if n.strip()]
    return series_of_texts(spark.createDataFrame([("text", content)], "series_id string, content string"), signals, sep, time_format)


def series_of_texts(texts: DataFrame, signals: list[str], sep: str = ";", time_format: str = TIME_FORMAT) -> DataFrame:
    """series_id, k, ts and signals of CSV texts (series_id, content), one a row; each has a line of names.

    Signals are found by name, so texts may order them differently; one
    that a text lacks is NULL.  Empty lines are left out.
    """
    lines = texts.select("series_id", F.split("content", "\r?\n").alias("_l")).select("series_id", F.split(F.col("_l")[0], f"[{sep}]").alias("_n"), F.posexplode(F.filter(F.slice("_l", 2, 1 << 30), lambda v: F.trim(v) != "")).alias("k", "_c"))
    cells = lines.withColumn("_c", F.split("_c", f"[{sep}]", -1))
    cell = lambda s: F.get("_c", F.nullif(F.array_position("_n", s), F.lit(0)).cast("int") - 1)
    ts = F.try_to_timestamp(F.get("_c", F.lit(0)), F.lit(time_format)).cast("timestamp_ntz")
    return cells.select("series_id", F.col("k").cast("bigint").alias("k"), ts.alias("ts"), *[parse_number(cell(s)).alias(s) for s in signals])


def csv_lines(df: DataFrame, signals: list[str], sep: str = ";", digits: int = 5) -> DataFrame:
    """series_id, k, line: a header (k = -1) and a line for each sample; missing values are NaN."""
    number = lambda s: F.coalesce(significant(F.col(s), digits).cast("string"), F.lit("NaN"))
    body = df.select("series_id", "k", F.concat_ws(sep, F.date_format("ts", TIME_FORMAT), *map(number, signals)).alias("line"))
    head = df.select("series_id").distinct().select("series_id", F.lit(-1).cast("long").alias("k"), F.lit(sep.join(["Time", *signals])).alias("line"))
    return head.unionByName(body)


def write_csv(df: DataFrame, path: str, signals: list[str], sep: str = ";", digits: int = 5) -> None:
    """One folder for each series, lines in order, ended by CR LF."""
    lines = csv_lines(df, signals, sep, digits)
    lines.repartition("series_id").sortWithinPartitions("series_id", "k").select("series_id", "line").write.mode("overwrite").partitionBy("series_id").option("lineSep", "\r\n").text(path)


def _later(df: DataFrame, there: DataFrame) -> DataFrame:
    """Of each series in `df` the samples after the last one in `there` (series_id as text, ts), to the second."""
    last = there.groupBy(F.col("series_id").alias("_s")).agg(F.max("ts").alias("_t"))
    second = F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    joined = df.join(last, F.col("series_id").cast("string").eqNullSafe(F.col("_s")), "left")
    return joined.where(F.col("_t").isNull() | (second > F.col("_t"))).select(df.columns)


def update_csv(df: DataFrame, path: str, signals: list[str], sep: str = ";", digits: int = 5) -> None:
    """Append to what ``write_csv`` or this wrote: of each series the samples after the last that is there.

    The new samples are files of their own in the folder of their series,
    so what is there isn't written again; their lines have their own line
    of names.  Spark's writer moves the files of a task into place once,
    after it succeeded, so a failed task leaves no rows.
    """
    lines = csv_lines(_later(df, _parts(df.sparkSession, path, sep)), signals, sep, digits)
    lines.repartition("series_id").sortWithinPartitions("series_id", "k").select("series_id", "line").write.mode("append").partitionBy("series_id").option("lineSep", "\r\n").text(path)


def _parts(spark: SparkSession, path: str, sep: str, time_format: str = TIME_FORMAT) -> DataFrame:
    """series_id (text), ts, the signals and `_at`, the place of a line: file, its part and the line in that."""
    rows = spark.read.option("mode", "PERMISSIVE").csv(path, sep=sep, header=True)
    time, *signals = [c for c in rows.columns if c != "series_id"]
    ts = F.try_to_timestamp(F.col(f"`{time}`"), F.lit(time_format)).cast("timestamp_ntz")
    # Files are named by the number of the task that wrote them; parts of a file aren't read in order.
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
    at = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.col("series_id").cast("string").alias("series_id"), ts.alias("ts"), at.alias("_at"), *[F.nanvl(parse_number(F.col(f"`{s}`")), F.lit(None)).alias(s) for s in signals])


def read_parts(spark: SparkSession, path: str, sep: str = ";", time_format: str = TIME_FORMAT) -> DataFrame:
    """series_id (text), k, ts and signals of the files in each series' folder, or of files of many series, in the order of time."""
    return numbered(_parts(spark, path, sep, time_format), [F.col("ts"), F.col("_at")]).drop("_at")


def write_shared(df: DataFrame, path: str, signals: list[str], sep: str = ";", digits: int = 5, mode: str = "overwrite") -> None:
    """CSV files of many series, whose first column is the series; its lines are in order, over one file or several.

    The number of files follows from the size of the data, not from the
    number of series, so this is for series too many to have a folder each.
    """
    number = lambda s: F.coalesce(significant(F.col(s), digits).cast("string"), F.lit("NaN"))
    rows = df.select(F.col("series_id"), "k", F.date_format("ts", TIME_FORMAT).alias("Time"), *[number(s).alias(s) for s in signals])
    sort = rows.repartitionByRange("series_id", "k").sortWithinPartitions("series_id", "k")
    sort.drop("k").write.mode(mode).csv(path, header=True, sep=sep, lineSep="\r\n")


def update_shared(df: DataFrame, path: str, signals: list[str], sep: str = ";", digits: int = 5) -> None:
    """Append to what ``write_shared`` or this wrote, as files beside those that are there: of each series the samples after the last that is there."""
    write_shared(_later(df, _parts(df.sparkSession, path, sep)), path, signals, sep, digits, "append")


def read_shared(spark: SparkSession, path: str, sep: str = ";", time_format: str = TIME_FORMAT) -> DataFrame:
    """series_id (text), k, ts and signals of what ``write_shared`` wrote, in the order of its lines."""
    return numbered(_parts(spark, path, sep, time_format), [F.col("_at")]).drop("_at")


def write_vector(df: DataFrame, path: str) -> None:
    """One number on a line, in order."""
    df.repartition("series_id").sortWithinPartitions("series_id", "k").select("series_id", F.coalesce(F.col("x").cast("string"), F.lit("NaN")).alias("line")).write.mode("overwrite").partitionBy("series_id").text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """series_id, k, x; lines that are no number are NULL."""
    x = F.col("value").try_cast("double")
    return _numbered(spark.read.text(path)).select("series_id", "k", F.when(F.isnan(x), None).otherwise(x).alias("x"))


def write_xy(df: DataFrame, path: str, columns: list[str], digits: int = 5) -> None:
    """Named rows, comma-separated, to so many digits."""
    df.select("name", *[significant(F.col(c), digits).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


#: Entries of a cache that hold no signal (fixed values).
NO_SIGNALS = ["Dmmy", "Negative9999", "UnixTime", "Ts", "HistoryDays"]
#: Formats of the times of a cache.
CACHE_TIMES = ["dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """series_id, signal, constant, errors and values of cache files, one row a signal.

    A line holds one signal, so a file is read line by line by any number
    of tasks.  Only what comes before `eventData` is read; lines with empty
    places in lists are dropped, as are those that are no JSON.  Signals of
    one value are constants; `errors` counts values that are no number.
    The signal 'Time' has its texts in `times`.
    """
    # Parts of a file aren't read in order: a line's place is where its part begins, then its place in it.
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("series_id"), F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")).alias("at"), "value",
    )
    ends = lines.where(F.col("value").contains("eventData")).groupBy(F.col("series_id").alias("_s")).agg(F.min("at").alias("_end"))
    cache = lines.join(ends, F.col("series_id") == F.col("_s"), "left").where(F.col("_end").isNull() | (F.col("at") < F.col("_end")))
    whole = cache.where(~F.col("value").rlike(r",,|\[,|,\]"))
    entry = F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), "map<string,string>")
    named = whole.withColumn("_e", F.map_values(entry)).where(F.size("_e") >= 2)
    text = F.col("_e")[1]
    values = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    one = named.select("series_id", F.col("_e")[0].alias("signal"), values.alias("_v")).where(~F.col("signal").isin(NO_SIGNALS) & F.col("_v").isNotNull())
    time, none = F.col("signal") == "Time", F.array()
    numbers = F.transform("_v", lambda v: v.try_cast("double"))
    return one.withColumn("numbers", F.when(time, none.cast("array<double>")).otherwise(numbers)).select(
        "series_id", "signal", (F.size("numbers") == 1).alias("constant"), F.size(F.filter("numbers", lambda v: v.isNull())).alias("errors"), "numbers",
        F.when(time, F.col("_v")).otherwise(none.cast("array<string>")).alias("times"),
    )


def write_cache(df: DataFrame, path: str, signals: list[str], bad: float = BAD) -> None:
    """A cache file in a folder for each series: a line for its times and one for each signal; missing values are `bad`.

    A signal of a series is one line, as the format has it, and so one row.
    """
    number = lambda s: F.coalesce(F.col(s).cast("double"), F.lit(bad)).cast("string")
    cells = [("Time", F.concat(F.lit('"'), F.date_format("ts", CACHE_TIMES[0]), F.lit('"')))] + [(s, number(s)) for s in signals]
    rows = df.select("series_id", "k", F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in cells])).alias("_i", "c"))
    packed = rows.groupBy("series_id", "_i", F.col("c.n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c.v"))), lambda c: c["v"]), ",").alias("v"))
    body = packed.select("series_id", "_i", F.format_string('{"n":"%s","v":[%s]},', "n", "v").alias("line"))
    frame = df.select("series_id").distinct().select("series_id", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("line")) for i, t in ((-1, "cacheContent = ["), (1 << 20, "];"), (1 << 21, "var eventData = [];"))])))
    body.unionByName(frame).repartition("series_id").sortWithinPartitions("series_id", "_i").select("series_id", "line").write.mode("overwrite").partitionBy("series_id").text(path)


def cache_series(cache: DataFrame) -> DataFrame:
    """series_id, k, ts, signal, x: the samples of ``read_cache``, constants left out.

    A signal that is longer than the times ends with them.
    """
    ts = F.coalesce(*[F.try_to_timestamp("_t", F.lit(f)) for f in CACHE_TIMES]).cast("timestamp_ntz")
    times = cache.where("signal = 'Time'").select("series_id", F.posexplode("times").alias("k", "_t"))
    values = cache.where("signal <> 'Time' and not constant").select("series_id", "signal", F.posexplode("numbers").alias("k", "x"))
    return values.join(times, ["series_id", "k"]).select("series_id", F.col("k").cast("bigint").alias("k"), ts.alias("ts"), "signal", clean(F.col("x")).alias("x"))
