"""Filters in blocks against the sample-by-sample machines."""

import math

import numpy as np
import pytest

from sigmill.operators import recursive as C


def recursion(kind):
    """Filters at a time base of 1 s, from their definitions."""
    def low(v, y, tc):
        return v if y is None else v + (y - v) * tc / (1 + tc)

    def run():
        kept = {}

        def step(v):
            if kind == "low, order 2":
                first = not kept
                kept["i"] = 0.0 if first else low(v, kept["i"], 5.0)
                kept["y"] = v if first else low(kept["i"], kept["y"], 5.0)
                return kept["y"]
            if kind.startswith("second"):
                kept["n"] = kept.get("n", 0) + 1
                if kind.endswith("off") or kept["n"] <= 2:
                    kept["y"] = (v, v)
                    return v
                w, (y1, y2) = 2 / 5, kept["y"]
                # (y - 2 y1 + y2) + 2 d w (y - y1) + w^2 (y - x) = 0
                kept["y"] = ((w * w * v + 2 * y1 - y2 + w * y1) / (1 + w + w * w), y1)
                return kept["y"][0]
            for tc in (5.0, 2.0, 9.0):
                kept[tc] = low(v, kept.get(tc), tc)
            return {"low": kept[5.0], "high": v - kept[5.0], "band": kept[9.0] - kept[2.0]}[kind]

        return step

    return run


FILTERS = {
    "low": C.low_pass_of(5.0), "low, order 2": C.low_pass_of(5.0, order=2), "high": C.high_pass_of(5.0), "band": C.band_pass_of(2.0, 9.0),
    "second": C.second_order_of(5.0, 0.5), "second, off": C.second_order_of(0.0, 0.5),
}
MACHINES = {k: (f, recursion(k)) for k, f in FILTERS.items()}


@pytest.mark.parametrize("name", MACHINES)
def test_scan_equals_machine(name):
    f, make = MACHINES[name]
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 300):
        x = rng.normal(50, 20, n)
        step = make()
        want = [step(v) for v in x.tolist()]
        got = f.values(x, f.states(x, True, np.zeros(len(f.c))))
        assert got == pytest.approx(want, abs=1e-9)
        machine = C.Machine(f)
        assert [machine.step(v) for v in x.tolist()] == pytest.approx(want, abs=1e-9)


def test_blocks_equal_machine_with_missing_samples(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 50), ("b", 3), ("c", 1), ("gone", 9)):
        for k in range(n):
            hole = s == "gone" or rng.random() < 0.3 or s == "a" and (k < 9 or 20 <= k < 33)
            rows.append((s, k, None if hole and s != "c" else float(rng.normal())))
    df = spark.createDataFrame(rows, "series_id string, k bigint, x double")
    for f, make in MACHINES.values():
        want = {(r.series_id, r.k): r.y for r in C.filtered(df, make).collect()}
        for block in (8, 4096):
            got = C.linear(df, f, block=block).collect()
            assert len(got) == len(rows)
            assert {(r.series_id, r.k, r.x) for r in got} == set(rows)
            for r in got:
                y = want[r.series_id, r.k]
                if y is None or math.isnan(y):
                    assert r.y is None
                else:
                    assert r.y == pytest.approx(y, abs=1e-9)
    assert C.linear(df.limit(0), C.low_pass_of(5.0)).count() == 0
