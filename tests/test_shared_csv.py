"""CSV files of many series: as many as the data needs, not one for each series."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigmill import queries
from sigmill.queries import files as of_files
from sigmill.sources import files

START = datetime(2024, 1, 1)
SCHEMA = "series_id string, k bigint, ts timestamp_ntz, x double"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("many"))
    spark.range(60 * 55).select(
        F.col("id").alias("event_id"), (F.col("id") % 60).alias("user_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
        F.lit("view").alias("event_type"), (F.col("id") % 1000 / 10).cast("double").alias("value"),
    ).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize(("name", "writes"), [("csv_files", 1), ("csv_appended", 3)])
def test_files_do_not_grow_with_the_number_of_series(spark, sf, monkeypatch, tmp_path, name, writes):
    monkeypatch.setattr(of_files, "new_place", lambda spark, kind: f"{tmp_path}/{kind}")
    got = {(x.series_id, x.k): (x.ts, x.x) for x in queries.queries()[name](spark, sf).collect()}
    want = {(i % 60, i // 60): (START + timedelta(seconds=i), None if i % 97 == 0 else i % 1000 / 10) for i in range(60 * 55)}
    assert got == want
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < len(list(Path(tmp_path).rglob("part-*"))) <= writes * parts < 60


def test_lines_keep_their_order_over_files_and_their_parts(spark, tmp_path):
    """One time for all samples, so that only the place of a line tells their order."""
    rows = spark.range(4000).select(F.lit("a;\"b\"").alias("series_id"), F.col("id").alias("k"), F.lit(START).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("x"))
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "3000"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        files.write_shared(rows, f"{tmp_path}/one", ["x"])
        assert len(list((tmp_path / "one").glob("part-*"))) > 1
        got = files.read_shared(spark, f"{tmp_path}/one").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(x.series_id, x.k, x.x) for x in got} == {('a;"b"', i, float(i)) for i in range(4000)}


@pytest.mark.parametrize("shared", [True, False])
def test_appending_again_writes_nothing(spark, tmp_path, shared):
    path = f"{tmp_path}/set"
    write, update = (files.write_shared, files.update_shared) if shared else (files.write_csv, files.update_csv)
    all_rows = [(s, k, START + timedelta(seconds=k), None if k == 3 else k + 0.5) for s in ("a", "b") for k in range(6)]
    df = spark.createDataFrame(all_rows, SCHEMA)
    write(df.where("series_id = 'a' and k < 2"), path, ["x"])
    for cut in ("k < 4", "k >= 2", "true"):
        update(df.where(cut), path, ["x"])
    assert {tuple(x) for x in files.read_parts(spark, path).select("series_id", "k", "ts", "x").collect()} == set(all_rows)
    assert sum(len(p.read_text().splitlines()) - 1 for p in Path(path).rglob("part-*") if p.stat().st_size) == 12
