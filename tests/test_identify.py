"""Truth in, estimate out: models, plants and identification."""

import json

import numpy as np
import pytest

from sigmill.plans import identify as I
from sigmill.plans import models as M
from sigmill.plans import plant as P
from sigmill.sources.plants import plant_from_json, plant_to_json


def noise(n, a=0.01, seed=0):
    return np.random.default_rng(seed).uniform(-a, a, n)


def unit(gains, bias=0.0, tc=0.0, delay=0.0, **more):
    return M.UnitModel("m", M.UnitParameters(gains, bias, tc, delay, **more), [f"u{i}" for i in range(len(gains))], "y")


@pytest.mark.parametrize("bias,tc,delay", [(21, 0, 0), (21, 10, 0), (1, 2, 0), (0, 10, 5), (0, 0, 10), (1, 5, 5)])
def test_unit_with_one_input(bias, tc, delay):
    u = np.where(np.arange(100) <= 40, 0.0, 1.0)
    y = P.simulate_single(unit([1.5], bias, tc, delay), [u], 1.0) + noise(100)
    p, sim = I.identify_unit(y, u, 1.0)
    assert p.gains[0] == pytest.approx(1.5, abs=0.1)
    assert p.time_constant_s == pytest.approx(tc, abs=max(0.1, 0.1 * tc)) and p.delay_s == pytest.approx(delay, abs=0.1)
    assert p.fitting["able"] and not p.warnings and np.abs(sim - y).mean() < 0.05


def test_unit_with_two_inputs_and_bad_data():
    u = np.column_stack([np.where(np.arange(200) <= 40, 0.0, 1.0), np.where(np.arange(200) <= 110, 0.0, 2.0)])
    y = P.simulate_single(unit([1.5, -2.0], 3, 8, 3), list(u.T), 1.0) + noise(200)
    y[60], y[61], u[130, 0] = np.nan, -9999, -9999
    p, _ = I.identify_unit(y, u, 1.0)
    assert p.gains == pytest.approx([1.5, -2.0], abs=0.1) and p.time_constant_s == pytest.approx(8, rel=0.1) and p.delay_s == 3


def test_unit_with_curvature_and_limits():
    u = np.repeat([0.0, 0.8, 1.6, 2.4], 60)
    y = P.simulate_single(unit([1.0], 1, 5, curvatures=[0.4]), [u], 1.0) + noise(240)
    p, _ = I.identify_unit(y, u, 1.0)
    assert p.curvatures[0] == pytest.approx(0.4, abs=0.04)
    y[100:110] = 50
    p, _ = I.identify_unit(y, u, 1.0, I.FittingSpecs(y_max_fit=20))
    assert p.curvatures[0] == pytest.approx(0.4, abs=0.08)


def test_constant_input_is_flagged():
    p, _ = I.identify_unit(noise(50), np.ones(50), 1.0)
    assert "ConstantInputU0" in p.warnings


def loop(pid, process):
    return P.feedback_loop(process, M.PidModel("C", pid, ["y", "yset"], "u"))


@pytest.mark.parametrize("amplitude", [1, 2, 5])
def test_pid_from_set_point_steps(amplitude):
    plant = loop(M.PidParameters(0.5, 20), unit([1.0], 5, 10, 5))
    yset = np.where(np.arange(200) < 50, 50.0, 50.0 + amplitude)
    sim, restarts = plant.run({"yset": yset}, 1.0)
    assert restarts == 0
    p, _ = I.identify_pid(sim["y"] + noise(200), yset, sim["u0" if "u0" in sim else "u"], 1.0)
    assert p.kp == pytest.approx(0.5, rel=0.05) and p.ti_s == pytest.approx(20, rel=0.05)


def test_gain_schedule_recovers_threshold():
    u = np.repeat(np.arange(16.0), 25)
    g = M.GainSchedParameters([[1.0], [3.0]], [6.0], [4.0], operating_u=5, operating_y=10)
    y = P.simulate_single(M.GainSchedModel("g", g, ["u"], "y"), [u], 1.0)
    p, _ = I.identify_gain_sched(y, u, 1.0)
    assert p.thresholds[0] == pytest.approx(6, abs=0.2) and p.gains == [pytest.approx([1.0], abs=0.05), pytest.approx([3.0], abs=0.05)]
    assert p.fitting["fit_score_prc"] > 97
    given, _ = I.identify_gain_sched_given(y, u, 1.0, [6.0])
    assert given.fitting["fit_score_prc"] > 97


@pytest.mark.parametrize("tc", [0, 10])
@pytest.mark.parametrize("step", [-5, 5, 10])
def test_closed_loop_with_a_step_disturbance(tc, step):
    process = M.UnitModel("P", M.UnitParameters([1.5], 5, tc), ["u"], "y", ["D"])
    pid, n = M.PidParameters(0.2, 20), 300
    d = np.where(np.arange(n) < 100, 0.0, step)
    sim, _ = loop(pid, process).run({"yset": np.full(n, 50.0), "D": d}, 1.0)
    model, _ = I.identify_closed_loop(sim["y"], np.full(n, 50.0), sim["u"], 1.0, pid)
    assert model.gains[0] == pytest.approx(1.5, rel=0.10 if tc else 0.05)
    assert I.disturbance(sim["y"], sim["u"], process.p, 1.0) == pytest.approx(d, abs=1e-3)


def test_gain_integral_goes_both_ways():
    g = M.GainSchedParameters([[1.0], [2.0], [0.5]], [2.0, 4.0])
    assert g.integral(1, 5, 0) == 1 + 4 + 0.5 == -g.integral(5, 1, 0) and g.integral(3, 3, 0) == 0
    before = M.GainSchedModel("g", g, ["u"], "y").steady_output([3.0])
    g.move_operating_point(4.5)
    assert M.GainSchedModel("g", g, ["u"], "y").steady_output([3.0]) == pytest.approx(before)


def steady(v):
    return abs(v[0] - v[1]) < 0.01 and abs(v[-1] - v[-2]) < 0.01


def test_serial_and_select_plants():
    p1 = M.UnitModel("P1", M.UnitParameters([1.0, 0.5], 5, 10, 5), ["a", "b"], "y1")
    p2 = M.UnitModel("P2", M.UnitParameters([1.1, 0.6], 5, 20, 10), ["a", "b"], "y2")
    p3 = M.UnitModel("P3", M.UnitParameters([0.8, 0.7], 5, 20, 10), ["y1", "y2"], "y3")
    plant = P.Plant([p3, M.SelectModel("S", "MAX", ["y1", "y2"], "ys"), p1, p2])
    sim, _ = plant.run({"a": np.ones(300), "b": np.ones(300)}, 1.0)
    assert sim["ys"][0] == sim["ys"][-1] == pytest.approx(6.7)
    assert sim["y3"][-1] == pytest.approx(5 + 0.8 * 6.5 + 0.7 * 6.7)
    assert all(len(v) == 300 and steady(v) for v in sim.values())
    assert plant.all_upstream("P3") == ["P1", "P2"] and plant.downstream("P1") == ["P3", "S"]
    assert plant.order.index("P1") < plant.order.index("P3")


def test_cascade_and_select_loops():
    inner = M.UnitModel("Inner", M.UnitParameters([1.0], 2, 3), ["u2"], "y2")
    outer = M.UnitModel("Outer", M.UnitParameters([0.9], 5, 30), ["y2"], "y1")
    plant = P.Plant([inner, outer, M.PidModel("C1", M.PidParameters(0.5, 40), ["y1", "r1"], "r2"), M.PidModel("C2", M.PidParameters(1.0, 8), ["y2", "r2"], "u2")])
    n = 800
    sim, _ = plant.run({"r1": np.where(np.arange(n) < 100, 40.0, 45.0)}, 1.0)
    assert sim["y1"][0] == pytest.approx(40) and sim["y1"][-1] == pytest.approx(45, abs=0.05) and steady(sim["y1"])
    a = M.UnitModel("A", M.UnitParameters([1.0], 5, 10), ["u"], "ya")
    b = M.UnitModel("B", M.UnitParameters([1.0], 10, 10), ["u"], "yb")
    pids = [M.PidModel("CA", M.PidParameters(0.5, 20, tracking_offset=5), ["ya", "ra", "u"], "ua"), M.PidModel("CB", M.PidParameters(0.5, 20, tracking_offset=5), ["yb", "rb", "u"], "ub")]
    plant = P.Plant([a, b, M.SelectModel("S", "MIN", ["ua", "ub"], "u"), *pids])
    sim, _ = plant.run({"ra": np.full(400, 50.0), "rb": np.full(400, 60.0)}, 1.0)
    assert sim["ya"][-1] == pytest.approx(50, abs=0.1)
    assert sim["yb"][-1] == pytest.approx(55, abs=0.1)


def test_computational_loop():
    a = M.UnitModel("A", M.UnitParameters([0.5, 1.0], 1, 5), ["yb", "x"], "ya")
    b = M.UnitModel("B", M.UnitParameters([0.4], 2, 5), ["ya"], "yb")
    sim, _ = P.Plant([a, b]).run({"x": np.full(200, 3.0)}, 1.0)
    ya = (1 + 3 + 0.5 * 2) / (1 - 0.2)
    assert sim["ya"][0] == pytest.approx(ya, abs=1e-6) and sim["ya"][-1] == pytest.approx(ya, abs=1e-3)


def test_bad_data_holds_and_restarts():
    plant = P.Plant([unit([1.0], 0, 50)])
    u = np.where(np.arange(300) < 50, 0.0, 1.0)
    ignore = np.zeros(300, bool)
    ignore[100:103] = True
    bad = u.copy()
    bad[100:103] = np.nan
    sim, restarts = plant.run({"u0": bad}, 1.0, ignore)
    clean, _ = plant.run({"u0": u}, 1.0)
    assert restarts == 0 and np.abs(sim["y"] - clean["y"]).max() < 0.05
    ignore[100:160] = True
    assert plant.run({"u0": u}, 1.0, ignore)[1] == 1


def test_divide_select_and_pid_options():
    d = M.DivideModel("D", ["a", "b"], "y", 2.0, y_max=10)
    assert [d.step(v, 1)[0] for v in ([4, 2], [1, 0], [None, 1], [100, 1])] == [4, -9999, -9999, 10]
    s = M.SelectModel("S", "MIN", ["a", "b"], "y")
    assert s.step([3, -9999], 1)[0] == 3 and s.step([3, 2], 1)[0] == 2
    p = M.PidController(M.PidParameters(1.0, 0.0, u0=50), 1.0)
    assert p.step(40, 45) == 55 and p.step(float("nan"), 45) == 55
    c = M.PidController(M.PidParameters(0.5, 10.0, 2.0), 1.0)
    c.warm_start(50, 50, 20)
    assert [c.step(v, 50) for v in (48, 48, 52)] == pytest.approx([20 + 1 + 0.1 + 2, 23.1 + 0.1 - 2, 21.2 - 2 - 0.1 - 4])


def test_plant_json_round_trip():
    process = M.UnitModel("P", M.UnitParameters([1.0], 5, 10, 5), ["u"], "y", ["D"])
    g = M.GainSchedModel("G", M.GainSchedParameters([[1.0], [2.0]], [50.0], operating_u=40), ["y"], "z")
    plant = P.Plant([*loop(M.PidParameters(0.5, 20), process).models.values(), g, M.DivideModel("Q", ["z", "y"], "q"), M.SelectModel("S", "MAX", ["z", "q"], "s")])
    data = {"yset": np.where(np.arange(100) < 30, 50.0, 55.0), "D": np.zeros(100)}
    a, b = plant.run(data, 1.0)[0], plant_from_json(plant_to_json(plant)).run(data, 1.0)[0]
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_common_plant_document():
    text = json.dumps({"plantName": None, "modelDict": {
        "PID1": {"$type": "X.PidModel, X", "pidParameters": {"Kp": 0.5, "Ti_s": "20", "Td_s": 0}, "ModelInputIDs": ["Y", "R"], "outputID": "U"},
        "P": {"$type": "X.UnitModel, X", "modelParameters": {"Y_min": "NaN", "Y_max": "NaN", "TimeConstant_s": 10, "TimeDelay_s": 5, "LinearGains": ["1"], "Bias": 5}, "ModelInputIDs": ["U"], "additiveInputIDs": ["D"], "outputID": "Y"},
        "D": {"$type": "X.UnitModel, X", "modelParameters": {"TimeConstant_s": 30, "LinearGains": ["0.5"], "Curvatures": ["0.3"], "Bias": 0}, "ModelInputIDs": ["Noise"], "outputID": "D"},
    }})
    plant = plant_from_json(text)
    assert plant.external == ["Noise", "R"] and plant.controlled == {"Y": "P"}
    sim, _ = plant.run({"R": np.where(np.arange(400) < 100, 50.0, 55.0), "Noise": np.zeros(400)}, 1.0)
    assert sim["Y"][0] == 50 and sim["Y"][-1] == pytest.approx(55, abs=0.05)
