"""Queries that once ran over a part of their tables, against brute force on a small fixture."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from sigmill import queries
from sigmill.queries import models


@pytest.fixture(scope="module")
def events():
    """Ids beyond 20, series of up to 70 samples, five types, and times outside January 2024."""
    r = random.Random(3)
    types, start = ("click", "view", "purchase", "signup", "error"), datetime(2023, 12, 30, 7, 20)
    return [
        (1000 + i, user, start + timedelta(seconds=60 * i + r.randrange(60)), types[r.randrange(5)], round(r.uniform(1, 99), 2))
        for i, user in enumerate(r.choice([0, 2, 25, 4000]) for _ in range(280))
    ]


@pytest.fixture(scope="module")
def sf(spark, events, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(events, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{d}/nation.parquet")
    return d


@pytest.fixture(scope="module")
def series(events):
    out = defaultdict(list)
    for e, user, ts, _, x in sorted(events, key=lambda v: (v[2], v[0])):
        out[user].append((ts, None if e % 97 == 0 else x))
    assert max(map(len, out.values())) > 50
    return out


def rows(spark, sf, name):
    got = [tuple(x) for x in queries.queries()[name](spark, sf).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_oversampling_takes_all_series_and_their_hours(spark, sf, series):
    low, high = min(v[0][0] for v in series.values()).replace(minute=0, second=0), max(v[-1][0] for v in series.values())
    want = set()
    for s, v in series.items():
        for h in range(int((high - low) / timedelta(hours=1)) + 1):
            t = low + timedelta(hours=h)
            before = max((k for k, (ts, _) in enumerate(v) if ts <= t), default=-1)
            want.add((s, t, before, v[before][1] if before >= 0 else None, next((k for k, (ts, _) in enumerate(v) if ts >= t), len(v) - 1)))
    assert rows(spark, sf, "asof_oversample") == want


def test_files_and_vectors_hold_every_sample(spark, sf, series):
    want = {(s, k, ts, -9999.0 if x is None else x) for s, v in series.items() for k, (ts, x) in enumerate(v)}
    assert rows(spark, sf, "csv_roundtrip") == want
    good = {s: [x for _, x in v if x is not None] for s, v in series.items()}
    assert rows(spark, sf, "matrix_transpose") == {(s, i, len(v), round(v[0] * (i + 1), 6), round(v[-1] * (i + 1), 6)) for s, v in good.items() for i in (0, 1)}
    cells = {s: text.strip("[]").split(";") for s, text in rows(spark, sf, "vec_to_string")}
    assert {s: [None if c == "NaN" else float(c) for c in v] for s, v in cells.items()} == {s: [x for _, x in v] for s, v in series.items()}


def test_every_event_type_is_a_signal(spark, sf, events):
    want = {}
    for _, user, ts, kind, x in events:
        key = (user, ts.replace(hour=0, minute=0, second=0), kind)
        want[key] = max(x, want.get(key, x))
    assert rows(spark, sf, "dataset_wide_long") == {(*k, x) for k, x in want.items()}


def test_searches_take_all_series(spark, sf, series):
    found = rows(spark, sf, "correlate_and_shift")
    assert {(s, signal) for s, signal, *_ in found} == {(s, signal) for s in series for signal in ("x", "y")}
    loops = rows(spark, sf, "ident_closed_loop")
    assert {x[0] for x in loops} == {x[0] for x in models._loops(spark, sf).select("series_id").distinct().collect()} and len(loops) == 24
