"""Operators on small known vectors, edge cases, files and streams."""

import random

import pytest
from pyspark.sql import functions as F

from sigmill.functions import generators as G
from sigmill.functions import reductions as R
from sigmill.functions import scalar as S
from sigmill.operators import dataset as D
from sigmill.operators import quality as Q
from sigmill.operators import recursive as C
from sigmill.operators import regression as L
from sigmill.operators import series as O
from sigmill.operators import spectrum as P
from sigmill.sources import files
from sigmill.streaming import stateful as T

NAN = float("nan")


@pytest.fixture(scope="module")
def make(spark):
    def build(values, name="s"):
        rows = [(name, k, None if v is None or v != v or v == -9999 else float(v)) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "series_id string, k bigint, x double")
        return df.withColumn("ts", F.lit("2010-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("k").cast("decimal(18,6)")))

    return build


def values(df, col="x"):
    return [r[col] for r in df.orderBy("series_id", "k").select(col).collect()]


def test_clean_and_divide(spark):
    df = spark.createDataFrame([(1.0, 2.0), (NAN, 2.0), (-9999.0, 1.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    out = df.select(S.divide(S.clean(F.col("a")), F.col("b")).alias("q"), S.subtract(S.clean(F.col("a")), 1.0, compat=True).alias("s")).collect()
    assert [r.q for r in out] == [0.5, None, None, None, None] and [r.s for r in out] == [0.0, 0.0, 0.0, 2.0, 0.0]


@pytest.mark.parametrize("x,n,want", [(243.1234, 4, 243.1), (0.0012345, 2, 0.0012), (99999.0, 1, 1e5), (-12.345, 3, -12.3), (0.0, 3, 0.0)])
def test_significant_digits(spark, x, n, want):
    assert spark.range(1).select(S.significant(F.lit(x), n)).first()[0] == want


@pytest.mark.parametrize("text,want", [("1,5", 1.5), (" 2.5 ", 2.5), ("1e3", 1000.0), ("abc", None), ("", None)])
def test_parse_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_number(F.col("t"))).first()[0] == want


def test_mean_square_error_skips_missing(make):
    df = make([1, NAN, 3, 4, 5, 6, 7, 8, 9, 10, 11]).withColumn("y", F.col("x") + 2)
    assert df.agg(R.square_error(F.col("x"), F.col("y"))).first()[0] == 4
    assert make([]).agg(R.mean(F.col("x"))).first()[0] == 0 and make([NAN, NAN]).agg(R.largest(F.col("x"))).first()[0] == R.LOWEST


@pytest.mark.parametrize("flagged,n,want", [({1, 5, 8}, 10, [0, 2, 3, 4, 6, 7, 9]), (set(), 3, [0, 1, 2]), ({0, 1, 2}, 3, []), ({0}, 1, [])])
def test_inverse(spark, flagged, n, want):
    f = spark.createDataFrame([("s", k) for k in flagged], "series_id string, k bigint")
    got = D.inverse(f, spark.createDataFrame([("s", n)], "series_id string, n bigint"))
    assert sorted(r.k for r in got.collect()) == want


def test_trailing(spark):
    f = spark.createDataFrame([("s", k) for k in (3, 6, 9)], "series_id string, k bigint")
    assert sorted(r.k for r in D.trailing(f).collect()) == [3, 4, 6, 7, 9, 10]


def test_downsample_prefers_good_samples(make):
    df = make(range(16))
    plain = O.downsample_good(df, 4, F.lit(False)).orderBy("block").collect()
    assert [r.x for r in plain] == [0, 4, 8, 12] and not any(r.flagged for r in plain)
    some = O.downsample_good(df, 4, F.col("k").isin(0, 5, 9, 10, 11, 12, 13)).orderBy("block").collect()
    # The first good sample is 1; the block that ends at 9 takes 8, the one that ends at 13 has none.
    assert [(r.x, r.flagged) for r in some] == [(1, False), (4, False), (8, False), (13, True)]


def test_windows_at_the_ends(make):
    df = make([1, 2, NAN, 4, 5, 6, 7])
    assert values(df.select("series_id", "k", O.smooth(F.col("x"), 1).alias("x"))) == [1, 1.5, 3, 4.5, 5, 6, 7]
    assert values(df.select("series_id", "k", O.moving_average(F.col("x"), 3).alias("x"))) == [1, 1.5, None, None, None, 5, 6]
    assert values(df.select("series_id", "k", O.delayed(F.col("x"), 2).alias("x"))) == [1, 2, 1, 2, None, 4, 5]
    assert values(df.select("series_id", "k", O.held(F.col("x"), F.col("k").isin(0, 3)).alias("x"))) == [1, 2, 2, 2, 5, 6, 7]
    assert O.difference(F.col("x")) is not None and values(make([5]).select("series_id", "k", O.difference(F.col("x")).alias("x"))) == [0]


@pytest.mark.parametrize("dt,tc", [(1, 6), (2, 12), (4, 24), (4, 12)])
def test_low_pass_step(make, dt, tc):
    step = [0.0] * 10 + [1.0] * 30
    got = values(C.low_pass(make(step), tc, dt), "y")
    assert got[10 + tc // dt] == pytest.approx(0.67, abs=0.02) and got[0] == 0 and got[-1] > 0.98
    holes = [NAN if k in (0, 11, 16) else v for k, v in enumerate(step)]
    assert values(C.low_pass(make(holes), tc, dt), "y") == got
    blocks = values(C.low_pass(make(step), tc, dt, block=7), "y")
    assert blocks == pytest.approx(got, abs=1e-12)


def test_filters_settle(make):
    x = make([3.0] * 60)
    one = lambda f: values(C.filtered(x, f), "y")
    assert one(lambda: C.Machine(C.high_pass_of(5.0)).step)[-1] == pytest.approx(0)
    assert one(lambda: C.Machine(C.band_pass_of(2.0, 9.0)).step)[-1] == pytest.approx(0)
    assert one(lambda: C.Machine(C.second_order_of(5.0, 0.5)).step)[-1] == pytest.approx(3)
    assert one(lambda: C.Machine(C.low_pass_of(5.0, order=2)).step)[-1] == pytest.approx(3, abs=0.01)
    assert one(lambda: C.Delay(1.0, 2.5).step)[:4] == [3, 3, 3, 3]


def test_ignored_samples(make):
    df = make([1, 2, NAN, 4, 4, 6, 7, 8])
    got = Q.ignored(df, ["x"], F.col("k") == 0)
    assert [r.k for r in got.where("ignore").orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert Q.oversampled_factor(make([k // 4 for k in range(40)]), ["x"]).first()[1:] == (4.0, 4)
    assert Q.oversampled_factor(make(range(40)), ["x"]).first()[1:] == (1.0, 0)


@pytest.mark.parametrize("bias", [0, 1, -1])
def test_exact_regression(make, bias):
    x1, x2 = [1, 0, 3, 4, 2], [0, 1, 1, 2, 5]
    df = make([a + 2 * b + bias for a, b in zip(x1, x2)])
    df = df.withColumn("a", F.element_at(F.array(*map(F.lit, map(float, x1))), F.col("k").cast("int") + 1)).withColumn("b", F.element_at(F.array(*map(F.lit, map(float, x2))), F.col("k").cast("int") + 1))
    fit = L.regress(df, F.col("x"), [F.col("a"), F.col("b")]).first()
    assert fit.params == pytest.approx([1, 2], abs=0.005) and fit.bias == pytest.approx(bias, abs=0.01) and fit.rsq > 99 and fit.able
    assert values(L.modelled(df, L.regress(df, F.col("x"), [F.col("a"), F.col("b")]), [F.col("a"), F.col("b")]), "y_mod") == pytest.approx(values(df), abs=0.01)


def test_regression_with_a_dead_input(make):
    df = make([10_000.0 + k for k in range(17)]).withColumn("a", F.col("k").cast("double")).withColumn("b", F.lit(0.0))
    fit = L.regress(df, F.col("x"), [F.col("a"), F.col("b")], regularise=[1]).first()
    assert fit.params[0] == pytest.approx(1, abs=0.01) and abs(fit.params[1]) < 0.1 and fit.near_constant == [1]
    assert L.regress(df.limit(0), F.col("x"), [F.col("a")]).count() == 0


def test_period(make):
    s = make([0.0] * 32).withColumn("x", G.sinus(F.col("k"), 5, 4))
    assert P.periods(s).first()["period_s"] == 4 and P.periods(make([2.0] * 32)).first()["period_s"] is None


def test_generators(spark):
    k = F.col("k")
    rows = G.grid(spark, 10, 0.5).select(G.step(k, 3, 0, 1).alias("s"), G.ramp(k, 4, 1, 4, 2).alias("r"), "ts").collect()
    assert [r.s for r in rows] == [0] * 4 + [1] * 6 and [r.r for r in rows] == [1, 1, 1, 2, 3, 4, 4, 4, 4, 4]
    assert (rows[3].ts - rows[0].ts).total_seconds() == 1.5


@pytest.mark.parametrize("name,sep,text,columns,first", [
    ("plain", ",", "variable,value1,value2\nvar1,1,2\nvar2,3,4\nvar3,5,6", ["variable", "value1", "value2"], [None, 1, 2]),
    ("surplus", ",", "variable,value1,value2\nvar1,1,2,9\nvar2,3,4", ["variable", "value1", "value2"], [None, 1, 2]),
    ("empty_name", ",", "variable,value1,value2,\nvar1,1,2,\nvar2,3,4,", ["variable", "value1", "value2"], [None, 1, 2]),
    ("empty_cells", ";", "variable;value1;value2\nvar1;1;\nvar2;3;", ["variable", "value1", "value2"], [None, 1, None]),
])
def test_csv_anomalies(spark, tmp_path, name, sep, text, columns, first):
    (tmp_path / f"{name}.csv").write_text(text)
    got = files.read_numbers(spark, f"{tmp_path}/{name}.csv", sep)
    assert got.columns == ["series_id", "k", *columns]
    assert list(got.orderBy("k").first()[2:]) == first


def test_csv_series(spark, tmp_path, make):
    (tmp_path / "dates.csv").write_text("Time;\n2024-11-26 12:29:33;\n2024-11-26 12:30:33;\n")
    assert files.read_series(spark, f"{tmp_path}/dates.csv") is None
    df = make([1.23456789, NAN, 3]).withColumnRenamed("x", "a")
    files.write_csv(df, f"{tmp_path}/out", ["a"])
    part = next((tmp_path / "out" / "series_id=s").glob("part-*"))
    assert part.read_bytes().split(b"\r\n")[:3] == [b"Time;a", b"2010-01-01 00:00:00;1.2346", b"2010-01-01 00:00:01;NaN"]
    back = files.read_series(spark, f"{tmp_path}/out/series_id=s").orderBy("k").collect()
    assert [r.a for r in back][0] == 1.2346 and back[2].k == 2
    text = files.series_from_text(spark, "Time;a;b\n2024-01-01 00:00:00;1,5;x\nbad;2;3").orderBy("k").collect()
    assert [tuple(r)[3:] for r in text] == [(1.5, None), (2.0, 3.0)] and text[1].ts is None


def test_vectors_and_cache_files(spark, tmp_path, make):
    files.write_vector(make([1.5, NAN, -2]), f"{tmp_path}/v")
    assert [r.x for r in files.read_vector(spark, f"{tmp_path}/v/series_id=s").orderBy("k").collect()] == [1.5, None, -2]
    cache = 'cacheContent = [\n{"n":"Time","v":["15.12.2022 08:00:00","15.12.2022 08:01:00"]},\n{"n":"A","v":[1.5,2]},\n{"n":"B","v":[7]},\n{"n":"C","v":[1,,2]},\n{"n":"D","v":["x",2]}\n];\nvar eventData = [];'
    (tmp_path / "cache.js").write_text(cache)
    got = {r.signal: r for r in files.read_cache(spark, f"{tmp_path}/cache.js").collect()}
    assert set(got) == {"Time", "A", "B", "D"} and got["A"].numbers == [1.5, 2] and got["B"].constant and got["D"].errors == 1
    assert got["Time"].times[0] == "15.12.2022 08:00:00"


def test_streams_equal_batch(spark, tmp_path, make):
    r = random.Random(1)
    x = [r.random() for _ in range(60)]
    df = make(x).select("series_id", "ts", "x")
    want = values(C.low_pass(make(x), 5.0), "y")
    place = f"{tmp_path}/in"
    for a, b in ((0, 20), (20, 60)):
        df.where(f"second(ts) >= {a} and second(ts) < {b}").coalesce(1).write.mode("append").parquet(place)
    # One file a batch; the second holds what is later than all of the first.
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)
    got = T.drained(T.low_pass(stream, 5.0)).orderBy("ts").collect()
    assert len(got) == 60 and [g.y for g in got] == pytest.approx(want)
    late = T.drained(T.frozen(spark.readStream.schema(df.schema).parquet(place))).collect()
    assert len(late) == 60 and sum(g.y for g in late) == 0 and {g.dropped for g in late} == {0}
    df.where("second(ts) >= 50").unionByName(df.where("second(ts) = 5")).coalesce(1).write.mode("append").parquet(place)
    again = T.drained(T.running_mean(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place))).collect()
    # Its last file has 11 samples that aren't later than the ones before.
    assert len(again) == 60 and {g.dropped for g in again} == {0}
    df.where("second(ts) = 59").withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(1))).coalesce(1).write.mode("append").parquet(place)
    end = T.drained(T.running_mean(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place))).orderBy("ts").collect()
    assert len(end) == 61 and end[-1].dropped == 11
    means = T.drained(T.windowed_mean(spark.readStream.schema(df.schema).parquet(place), width="30 seconds"))
    assert means.count() <= 2


def test_appended_rejects_earlier_times(make):
    df = make([1, 2, 3])
    more = make([9, 9, 9, 4, 5]).drop("k")
    assert values(O.appended(df, more.withColumn("k", F.lit(0).cast("long")))) == [1, 2, 3, 4, 5]
