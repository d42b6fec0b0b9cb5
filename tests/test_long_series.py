"""Operators that read one long series in many tasks, against brute force and with small blocks."""

import itertools
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import control, lagged, ordered, quality, regression, series, spectrum, tallqr, thresholds, units
from sigmill.operators.series import W
from sigmill.plans import identify, plant
from sigmill.plans.models import PidController, PidParameters, UnitModel, UnitParameters

SAMPLES = "series_id string, k bigint, x double"


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(2)
    rows = [(s, k, None if r.random() < 0.1 else float(r.normal(0, 5))) for s, n in (("a", 300), ("b", 7), ("c", 1), (None, 40)) for k in range(n)]
    return spark.createDataFrame(rows, SAMPLES).repartition(5)


def table(df, *cols):
    return {(r.series_id, r.k): tuple(r[c] for c in cols) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert v == pytest.approx(b[k], abs=1e-9), k


def test_numbers_of_a_series_over_many_ranges(spark):
    rows = [(s, i, (i * 7919) % 1000) for s, n in (("long", 5000), ("short", 3), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, i int, o int").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = ordered.numbered(df, [F.desc("o"), F.col("i")]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows) and got[0].asDict().keys() == {"series_id", "i", "o", "k"}
    for s in ("long", "short", None):
        mine = sorted((r for r in got if r.series_id == s), key=lambda r: r.k)
        assert [r.k for r in mine] == list(range(len(mine))) and [(-r.o, r.i) for r in mine] == sorted((-r.o, r.i) for r in mine)
    assert ordered.numbered(df.limit(0), [F.col("i")]).count() == 0


@pytest.mark.parametrize("block", [4, 64, 65_536])
def test_windows_in_blocks_equal_those_over_series(samples, block):
    x, flag = F.col("x"), F.coalesce(F.col("x") > 2, F.lit(False))
    ask = lambda w: [series.moving_average(x, 5, w).alias("m"), series.smooth(x, 3, w).alias("s"), series.difference(x, w).alias("d"), series.delayed(x, 4, w).alias("l")]
    far = series.Window.partitionBy("series_id").orderBy("k").rowsBetween(series.Window.unboundedPreceding, 0)
    want = table(samples.select("series_id", "k", *ask(W()), series.held(x, flag).alias("h"), F.coalesce(F.avg("x").over(far), F.lit(0.0)).alias("r")), "m", "s", "d", "l", "h", "r")
    both = ordered.running_mean(ordered.held(samples, x, flag, "h", block), x, "r", block)
    got = ordered.own(ordered.haloed(both, 4, 3, block).select("series_id", "k", "_b", *ask(ordered.B()), "h", "r"), block)
    close(table(got, "m", "s", "d", "l", "h", "r"), want)


def test_regression_at_a_large_offset(spark):
    """Unit spread at 1e8: sums of products would keep no digit of the slope."""
    r = np.random.default_rng(1)
    n = 4000
    a, b = 1e8 + r.integers(-8, 9, n) / 8, -1e8 + r.integers(-8, 9, n) / 16
    y = 3.0 * a - 2.0 * b + np.round(r.normal(size=n) * 1024) / 1024
    # Whole numbers of 1 / 1024, times n so that the means are whole too.
    ca, cb, cy = ([n * int(v) - int(sum(map(int, c))) for v in c] for c in (a * 1024, b * 1024, y * 1024))
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    det = dot(ca, ca) * dot(cb, cb) - dot(ca, cb) ** 2
    want = [float(Fraction(dot(ca, cy) * dot(cb, cb) - dot(cb, cy) * dot(ca, cb), det)), float(Fraction(dot(cb, cy) * dot(ca, ca) - dot(ca, cy) * dot(ca, cb), det))]
    df = spark.createDataFrame([("s", float(p), float(q), float(v)) for p, q, v in zip(a, b, y, strict=True)], "series_id string, a double, b double, y double").repartition(8)
    fit = regression.regress(df, F.col("y"), [F.col("a"), F.col("b")]).first()
    assert fit.params == pytest.approx(want, rel=1e-10) and fit.n == n and not fit.rank_deficient
    twin = regression.regress(df, F.col("y"), [F.col("a"), F.col("a") * 2 + 1]).first()
    assert twin.rank_deficient and twin.params[0] + 2 * twin.params[1] == pytest.approx(regression.regress(df, F.col("y"), [F.col("a")]).first().params[0], rel=1e-9)


def test_factors_merge_in_any_grouping():
    r = np.random.default_rng(0)
    rows = r.normal(size=(1000, 3)) @ r.normal(size=(3, 3)) + 1e6
    whole = tallqr.States.of_rows(rows).merged(np.array([0]))
    cuts = np.array([0, 1, 2, 500, 777])
    parts = tallqr.States.of_rows(rows).merged(cuts)
    tree = parts.merged(np.array([0, 2])).merged(np.array([0]))
    for s in (whole, tree):
        centred = rows - rows.mean(axis=0)
        assert s.n[0] == 1000 and s.r[0].T @ s.r[0] == pytest.approx(centred.T @ centred, rel=1e-9)
        assert (s.origin + s.mean)[0] == pytest.approx(rows.mean(axis=0), rel=1e-12) and (s.low[0] == rows.min(axis=0)).all()


def test_regression_of_many_series_and_nulls(spark):
    r = np.random.default_rng(5)
    rows = [(s if s else None, float(x), float(2 * x + s + r.normal() / 100)) for s in range(40) for x in r.normal(size=3 + s)] + [(1, None, 1.0), (1, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "series_id bigint, a double, y double").repartition(4)
    got = {g.series_id: g for g in regression.regress(df, F.col("y"), [F.col("a")]).collect()}
    assert len(got) == 40 and got[None].n == 3
    for s, g in got.items():
        mine = np.array([(a, y) for i, a, y in rows if i == s and a is not None and y == y])
        slope, bias = np.polyfit(mine[:, 0], mine[:, 1], 1)
        assert (g.params[0], g.bias) == pytest.approx((slope, bias), rel=1e-9) and g.n == len(mine)


def test_delays_are_found(spark):
    r = np.random.default_rng(7)
    rows = []
    for s, (delay, a) in {"p": (0, 0.0), "q": (3, 0.5), "r": (7, 0.8)}.items():
        u, y = r.normal(size=400), 0.0
        for k in range(400):
            y = a * y + 2.0 * (u[k - delay] if k >= delay else 0.0)
            rows.append((s, k, float(u[k]), float(y), None if k == 50 else 5.0))
    df = spark.createDataFrame(rows, "series_id string, k bigint, u double, y double, dead double").repartition(4)
    for block in (16, 65_536):
        got = {(g.series_id, g.signal): g for g in lagged.delays(df, "y", ["u", "dead"], 9, 0.5, block).collect()}
        assert len(got) == 3 or all(got[k].rsq is None for k in got if k[1] == "dead")
        for s, (delay, a) in {"p": (0, 0.0), "q": (3, 0.5), "r": (7, 0.8)}.items():
            g = got[s, "u"]
            assert g.delay_s == delay * 0.5 and g.gain == pytest.approx(2 / (1 - a), rel=1e-6) and g.time_constant_s == pytest.approx(0.5 * a / (1 - a), abs=1e-6) and g.rsq == pytest.approx(1)
    shifts = {(g.series_id, g.signal): g for g in lagged.strongest_shifts(df, "y", ["u", "y", "dead"], 9).collect()}
    assert shifts["p", "u"].corr == pytest.approx(1) and shifts["p", "u"].delay_s == 0 and shifts["r", "u"].delay_s is None and ("p", "dead") not in shifts


def test_spectrum_of_any_length(spark):
    r = np.random.default_rng(8)
    lengths = {"a": 1, "b": 2, "c": 3, "d": 31, "e": 64, "f": 1000, None: 17}
    data = {s: r.normal(size=n) for s, n in lengths.items()}
    df = spark.createDataFrame([(s, k, float(v)) for s, x in data.items() for k, v in enumerate(x)], SAMPLES).repartition(5)
    got = {(g.series_id, g.bin): complex(g.re, g.im) for g in spectrum.fourier(df).collect()}
    want = {(s, i): v for s, x in data.items() for i, v in enumerate(np.fft.fft(x[: 1 << len(x).bit_length() - 1]))}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("waves,want", [([(10, 84), (5, 7)], 84), ([(61, 13), (13, 10)], 13), ([], None)])
def test_period_of_two_waves(spark, waves, want):
    x = sum((a * np.sin(2 * np.pi * np.arange(2087) / p) for a, p in waves), np.full(2087, 5.0))
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], SAMPLES)
    got = spectrum.periods(df, block=100).first().period_s
    assert got is None if want is None else got == pytest.approx(want, rel=0.15)


def test_grid_equals_holds_of_a_joined_grid(spark):
    start = datetime(2024, 1, 1)
    minutes = {"a": [0, 5, 10, 10, 10, 11, 59, 60, 200], "b": [95], "c": [130, 131], None: [60, 60]}
    rows = [(s, k, start + timedelta(minutes=m), float(m + k)) for s, ms in minutes.items() for k, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "series_id string, k bigint, ts timestamp_ntz, x double")
    times = [start + timedelta(minutes=10 * i) for i in range(18)]
    for block in (2, 64):
        got = {(g.series_id, g.ts): (g.k_before, g.x_before, g.k_after) for g in series.on_grid(df, start, times[-1], timedelta(minutes=10), block).collect()}
        assert len(got) == 4 * 18
        for s, t in itertools.product(minutes, times):
            mine = [x for x in rows if x[0] == s]
            old = [x for x in mine if x[2] <= t]
            new = [x for x in mine if x[2] >= t]
            assert got[s, t] == ((old[-1][1], old[-1][3]) if old else (None, None)) + ((new[0] if new else mine[-1])[1],)
    grid = spark.createDataFrame([(s, t) for s in "abc" for t in times], "series_id string, ts timestamp_ntz")
    held = {(g.series_id, g.ts): g.k for g in series.oversample(df.where("series_id is not null"), grid).collect()}
    assert all(got[key][0] == k for key, k in held.items())


def test_flat_stretches_are_set_aside(spark):
    def hold(n, f, flats=()):
        v = [k - k % f for k in range(n)]
        for a, b in flats:
            v[a:b] = [v[a]] * (b - a)
        return v

    cases = {"even": hold(60, 3), "flat": hold(90, 3, [(30, 51)]), "two": hold(120, 4, [(20, 40), (80, 101)]), "none": list(range(40)), "wild": [0, 0, 0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 7, 7, 8, 9]}
    rows = [(s, k, float(v), float(-v)) for s, vs in cases.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, k bigint, y double, u double").repartition(3)
    for block in (8, 65_536):
        got = {g.series_id: g for g in quality.unit_oversampled_factor(df, "y", ["u"], block).collect()}
        assert (got["even"].factor, got["even"].key, got["even"].n_flat) == (3.0, 0, 0) and got["none"].factor == got["wild"].factor == 1.0
        assert got["flat"].n_flat == 1 and got["flat"].factor == pytest.approx(3, abs=0.35) and got["two"].n_flat == 2 and got["two"].factor == pytest.approx(4, abs=0.6)
        runs = {(g.series_id, g.first, g.last) for g in quality.repeat_runs(df, ["y", "u"], block).collect()}
        assert ("flat", 31, 50) in runs and ("even", 1, 2) in runs and not [r for r in runs if r[0] == "none"]
    alone = df.withColumn("u", F.col("k").cast("double"))
    assert quality.unit_oversampled_factor(alone, "y", ["u"]).where("factor > 1").count() == 0  # both must repeat


def test_best_split_against_all_splits(spark):
    r = np.random.default_rng(11)
    rows = []
    for s in range(6):
        u = np.round(r.uniform(0, 10, 80 if s else 5) * 4) / 4
        y = np.where(u <= 6, u, 6 + (u - 6) * s) + 1e5 + r.normal(size=len(u)) / 10
        rows += [(s, float(a), float(b)) for a, b in zip(u, y, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 2.0), (1, 2.0, None)], "series_id bigint, u double, y double").repartition(4)
    got = {g.series_id: g for g in thresholds.best_split(df, F.col("u"), F.col("y"), block=5).collect()}
    for s in range(1, 6):
        u, y = np.array([(a, b) for i, a, b in rows if i == s]).T
        best = None
        for t in sorted(set(u)):
            sides = [(u[m], y[m]) for m in (u <= t, u > t)]
            if all(len(a) >= 3 and np.ptp(a) > 0 for a, _ in sides):
                lines = [np.polyfit(a - 5, b - 1e5, 1) for a, b in sides]
                sse = sum(((b - 1e5 - np.polyval(c, a - 5)) ** 2).sum() for c, (a, b) in zip(lines, sides, strict=True))
                best = min(best or (sse + 1,), (sse, t, lines[0][0], lines[1][0]))
        g = got[s]
        assert (g.sse, g.threshold, g.gain_low, g.gain_high) == pytest.approx(best, rel=1e-6)


def test_controller_in_blocks_equals_its_steps(samples):
    for kp, ti, td in ((0.7, 12.0, 0.0), (-2.0, 5.0, 1.5), (30.0, 1.0, 0.0)):
        want = {}
        rows = sorted(((r.series_id or "", r.k, r.x) for r in samples.collect()))
        for s, group in itertools.groupby(rows, lambda r: r[0]):
            c = PidController(PidParameters(kp, ti, td), 1.0)
            want |= {(s or None, k): (c.step(float("nan") if x is None else x, 1.0),) for _, k, x in group}
        for block in (4, 65_536):
            close(table(control.pid(samples, F.col("x"), F.lit(1.0), kp, ti, td, block=block), "u"), want)
    assert control.pid(samples.limit(0), F.col("x"), F.lit(1.0), 1.0, 1.0).count() == 0


def test_units_and_disturbances_equal_their_steps(spark):
    r = np.random.default_rng(13)
    data = {"a": r.normal(size=(150, 3)), "b": r.normal(size=(6, 3)), "c": r.normal(size=(1, 3))}
    df = spark.createDataFrame([(s, k, *map(float, row)) for s, v in data.items() for k, row in enumerate(v)], "series_id string, k bigint, u double, v double, y double").repartition(4)
    for more in ({"time_constant_s": 6.0, "delay_s": 2.5}, {"time_constant_s": 4.0, "damping": 0.4}, {"curvatures": [0.5, 0.0], "unorm": [2.0, 1.0]}):
        p = UnitParameters([1.5, -0.5], 3.0, u0=[0.5, 0.0], **more)
        want, gone = {}, {}
        for s, x in data.items():
            y = plant.simulate_single(UnitModel("m", p, ["u", "v"], "y"), [x[:, 0], x[:, 1]], 1.0)
            want |= {(s, k): (v,) for k, v in enumerate(y)}
            gone |= {(s, k): (v,) for k, v in enumerate(identify.disturbance(x[:, 2], x[:, :2], p, 1.0))}
        for block in (8, 65_536):
            close(table(units.response(df, ["u", "v"], [1.5, -0.5], 3.0, [0.5, 0.0], block=block, **more), "y"), want)
            close(table(units.disturbance(df, "y", ["u", "v"], [1.5, -0.5], bias=3.0, u0=[0.5, 0.0], block=block, **more), "d"), gone)
    low = units.response(df, ["u"], [100.0], limits=(-1.0, 1.0)).agg(F.min("y"), F.max("y")).first()
    assert tuple(low) == (-1.0, 1.0)
