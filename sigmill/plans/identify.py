"""Identification of unit models, PID controllers, gain-scheduled models and closed loops.

Each estimator works on the arrays of one dataset; ``per_series`` runs one
over all series of a DataFrame, a group to a task.  Regressions are least
squares by pseudo-inverse; all candidates of a search are kept with their
metrics, so the choice can be looked into.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.recursive import Machine, low_pass_of
from .metrics import common, fit_score, rounded
from .models import GainSchedModel, GainSchedParameters, PidController, PidModel, PidParameters, UnitModel, UnitParameters
from .plant import simulate_single

LEAST_DELAYS = 5
#: Gain in R2 of differences, in points, from which curvatures are considered.
CURVATURE_GAIN = 0.1


@dataclass
class FittingSpecs:
    u0: list[float] | None = None
    unorm: list[float] | None = None
    y_min_fit: float | None = None
    y_max_fit: float | None = None
    u_min_fit: list[float | None] | None = None
    u_max_fit: list[float | None] | None = None


def clean(v: np.ndarray, bad: float = -9999.0) -> np.ndarray:
    v = np.asarray(v, float).copy()
    v[v == bad] = np.nan
    return v


def fit_mask(y: np.ndarray, u: np.ndarray, specs: FittingSpecs | None, ignore: np.ndarray | None) -> np.ndarray:
    """Samples to leave out: given ones, missing ones with the next, and those beyond limits."""
    out = np.zeros(len(y), bool) if ignore is None else ignore.copy()
    gone = np.isnan(y) | np.isnan(u).any(axis=1)
    out |= gone
    out[1:] |= gone[:-1]
    s = specs or FittingSpecs()
    with np.errstate(invalid="ignore"):
        for low, high, v in [(s.y_min_fit, s.y_max_fit, y)] + [
            ((s.u_min_fit or [None] * u.shape[1])[i], (s.u_max_fit or [None] * u.shape[1])[i], u[:, i]) for i in range(u.shape[1])
        ]:
            if low is not None and np.isfinite(low):
                out |= v < low
            if high is not None and np.isfinite(high):
                out |= v > high
    return out


def least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant last) and their standard errors."""
    a = np.column_stack([x, np.ones(len(y))])
    scale = np.maximum(np.abs(a).max(axis=0), 1e-12)
    inverse = np.linalg.pinv(a / scale, rcond=1e-10)
    b = inverse @ y / scale
    freedom = max(1, len(y) - a.shape[1])
    variance = ((y - a @ b) ** 2).sum() / freedom
    return b, np.sqrt(np.diag(inverse @ inverse.T) * variance) / scale


def simulate_unit(p: UnitParameters, u: np.ndarray, dt: float) -> np.ndarray:
    m = UnitModel("m", p, [f"u{i}" for i in range(u.shape[1])], "y")
    return simulate_single(m, list(u.T), dt)


def _filled(v: np.ndarray) -> np.ndarray:
    """Missing inputs hold the last value, leading ones the first."""
    return pd.Series(v).ffill().bfill().to_numpy()


def fit_unit(y, u, dt, delay, mask, dynamic, curved, u0, unorm, d=None) -> tuple[UnitParameters | None, np.ndarray | None]:
    """One fit with a delay of so many samples.

    Dynamic: y[k] - y[k-1] on y[k-1], u[k-delay] - u0 and its square, all
    with the disturbance taken off; static: y on u - u0.
    """
    n, m = u.shape
    x = y - (0 if d is None else d)
    begin = delay + (1 if dynamic else 0)
    k = np.arange(begin, n)
    lag = u[k - delay] - np.asarray(u0)
    columns = [lag[:, i] for i in range(m)]
    columns += [lag[:, i] ** 2 / unorm[i] for i in range(m) if curved[i]]
    if dynamic:
        columns.insert(0, x[k - 1])
    target = x[k] - x[k - 1] if dynamic else x[k]
    phi = np.column_stack(columns)
    good = ~mask[k] & ~mask[k - delay] & np.isfinite(target) & np.isfinite(phi).all(axis=1)
    if dynamic:
        good &= ~mask[k - 1]
    if good.sum() <= phi.shape[1] + 1:
        return None, None
    b, se = least_squares(target[good], phi[good])
    if not np.isfinite(b).all() or np.abs(b).max() > 1e8:
        return None, None
    a, tc = 0.0, 0.0
    if dynamic:
        a = b[0] + 1
        a = 0.0 if a > 1 or a <= 0 else a
        tc = max(0.0, dt / (1 / a - 1)) if 0 < a < 1 else 0.0
        b, se_a, se = b[1:], se[0], se[1:]
    gains = b[:m] / (1 - a)
    curvatures = None
    if any(curved):
        curvatures, c = [0.0] * m, list(b[m:-1] / (1 - a))
        for i in range(m):
            if curved[i]:
                curvatures[i] = float(c.pop(0))
    p = UnitParameters(rounded(gains), 0.0, rounded(tc), delay * dt, curvatures=rounded(curvatures), u0=list(map(float, u0)), unorm=list(map(float, unorm)))
    p.unc = {"gains": rounded(1.96 * se[:m] / (1 - a)), "bias": rounded(1.96 * se[-1] / (1 - a))}
    if dynamic and 0 < a < 1:
        p.unc["time_constant_s"] = rounded(1.96 * se_a * dt / (1 - a) ** 2)
    sim = simulate_unit(p, np.column_stack([_filled(u[:, i]) for i in range(m)]), dt)
    use = ~mask & np.isfinite(x)
    p.bias = rounded(float((x[use] - sim[use]).mean()))
    sim = sim + p.bias + (0 if d is None else d)
    p.fitting = common(y, sim, use) | {"able": True, "dynamic": dynamic, "n": int(good.sum())}
    return p, sim


def identify_unit(y, u, dt, specs: FittingSpecs | None = None, ignore=None, d=None, dynamic=True, curvature=True, delays=True, bad=-9999.0) -> tuple[UnitParameters, np.ndarray | None]:
    """Parameters of a unit model and its simulated output.

    Delays 0, 1, 2, ... are tried, at least LEAST_DELAYS and up to a
    quarter of the dataset, for as long as the objective or the R2 of
    differences of the last exceeds that of the one before; the largest R2
    decides.  A static model replaces it when it fits better.
    """
    y, u = clean(y, bad), clean(np.atleast_2d(np.asarray(u, float).T).T, bad)
    n, m = u.shape
    mask = fit_mask(y, u, specs, ignore)
    specs = specs or FittingSpecs()
    use = ~mask
    u0 = specs.u0 or [rounded(float(np.nanmean(u[use, i]))) if use.any() else 0.0 for i in range(m)]
    unorm = specs.unorm or [1.0] * m
    warnings = [f"ConstantInputU{i}" for i in range(m) if use.any() and np.nanmax(u[use, i]) == np.nanmin(u[use, i])]
    most = max(LEAST_DELAYS, n // 4) if delays else 0
    runs: list[tuple[UnitParameters, np.ndarray]] = []
    for delay in range(min(most, max(0, n - 4)) + 1):
        best = fit_unit(y, u, dt, delay, mask, dynamic, [False] * m, u0, unorm, d)
        if best[0] and curvature:
            full = fit_unit(y, u, dt, delay, mask, dynamic, [True] * m, u0, unorm, d)
            if full[0] and full[0].fitting["rsq_diff"] > best[0].fitting["rsq_diff"] + CURVATURE_GAIN:
                # Of all subsets of inputs, the curvatures that fit best.
                tries = [full] + [fit_unit(y, u, dt, delay, mask, dynamic, [bool(s >> i & 1) for i in range(m)], u0, unorm, d) for s in range(1, 2**m - 1)]
                best = max((t for t in [best, *tries] if t[0]), key=lambda t: t[0].fitting["fit_score_prc"])
        if best[0]:
            runs.append(best)
        if len(runs) >= 2 and delay >= LEAST_DELAYS:
            f0, f1 = runs[-2][0].fitting, runs[-1][0].fitting
            if not (f0["obj_diff"] < f1["obj_diff"] or f0["rsq_diff"] < f1["rsq_diff"]):
                break
    if not runs:
        p = UnitParameters([0.0] * m, fitting={"able": False}, warnings=[*warnings, "RegressionProblemFailedToYieldSolution"])
        return p, None
    p, sim = max(runs, key=lambda t: t[0].fitting["rsq_diff"])
    if dynamic:
        still = fit_unit(y, u, dt, 0, mask, False, [False] * m, u0, unorm, d)
        if still[0] and still[0].fitting["fit_score_prc"] > p.fitting["fit_score_prc"] and still[0].fitting["rsq_diff"] > p.fitting["rsq_diff"]:
            p, sim = still
    p.warnings = warnings
    return p, sim


def identify_with_fixed_gain(y, u, dt, index: int, gain: float, u0: float, ignore=None) -> UnitParameters:
    """Static fit of the other inputs while one gain stays as given."""
    y, u = clean(y), clean(np.atleast_2d(np.asarray(u, float).T).T)
    others = [i for i in range(u.shape[1]) if i != index]
    p, _ = identify_unit(y - gain * (u[:, index] - u0), u[:, others], dt, ignore=ignore, dynamic=False, curvature=False, delays=False)
    gains, u0s = list(p.gains), list(p.u0 or [])
    gains.insert(index, gain)
    u0s.insert(index, u0)
    p.gains, p.u0, p.unorm, p.unc = gains, u0s, [1.0] * len(gains), {}
    return p


# PID

def simulate_pid(p: PidParameters, y: np.ndarray, yset: np.ndarray, u_first: float, dt: float) -> np.ndarray:
    c = PidController(p, dt)
    c.warm_start(float(y[0]), float(yset[0]), float(u_first))
    u = np.array([c.step(float(a), float(b)) for a, b in zip(y, yset, strict=True)])
    return np.concatenate([u[:1], u[:-1]]) if p.delay_output else u


def identify_pid(y, yset, u, dt, ignore=None, bad=-9999.0, filters=(0.0, 1.0, 2.0, 4.0, 8.0)) -> tuple[PidParameters, np.ndarray | None]:
    """Kp and Ti from u[k] - u[k-1] on e[k] - e[k-1] and e[k] dt.

    Tried with the output as it is and one sample late, and with several
    filters on the measurement; the simulated output's fit score decides.
    Samples at the output's limits are left out.  Kp changes sign when
    that fits better; a Kp near zero means the controller isn't in auto.
    """
    y, yset, u = (clean(v, bad) for v in (y, yset, u))
    gone = np.isnan(y) | np.isnan(yset) | np.isnan(u) | (False if ignore is None else ignore)
    full = np.nanmax(u) - np.nanmin(u) if np.isfinite(u).any() else 0.0
    if full == 0 or (~gone).sum() < 5:
        return PidParameters(0.0, fitting={"able": False}, warnings=["ConstantOutput" if full == 0 else "TooFewSamples"]), None
    low, high = (0.0, 100.0) if np.nanmin(u) >= 0 and np.nanmax(u) <= 100 else (float(np.nanmin(u)), float(np.nanmax(u)))
    saturated = (u <= low) | (u >= high)
    yf, sf, uf = _filled(y), _filled(yset), _filled(u)
    best: tuple[float, PidParameters, np.ndarray] | None = None
    for late in (0, 1):
        for tc in filters:
            f = Machine(low_pass_of(tc * dt, dt))
            e = sf - (np.array([f.step(float(v)) for v in yf]) if tc else yf)
            k = np.arange(1 + late, len(u))
            de, ie, du = e[k - late] - e[k - late - 1], e[k - late] * dt, uf[k] - uf[k - 1]
            ok = ~(gone[k] | gone[k - 1] | gone[k - late] | gone[k - late - 1] | saturated[k] | saturated[k - 1])
            if ok.sum() < 4:
                continue
            b, se = least_squares(du[ok], np.column_stack([de[ok], ie[ok]]))
            if abs(b[0]) < 1e-7:
                continue
            for sign in (1, -1):
                p = PidParameters(rounded(sign * float(b[0])), rounded(abs(float(b[0] / b[1]))) if abs(b[1]) > 1e-12 else 0.0, u_range=(low, high), filter_tc_s=tc * dt, filter_order=1 if tc else 0, delay_output=bool(late))
                start = int(np.argmin(gone))
                sim = simulate_pid(p, yf, sf, uf[start], dt)
                score = fit_score(uf, sim, ~gone)
                # A filter must earn its place, so that noise doesn't choose one.
                if best is None or score > best[0] + (0.5 if tc else 0.0):
                    p.fitting = {"able": True, "fit_score_prc": rounded(score), "kp_unc": rounded(1.96 * float(se[0]))}
                    best = (score, p, sim)
    if best is None:
        return PidParameters(0.0, fitting={"able": False}, warnings=["NotPossibleToIdentify"]), None
    _, p, sim = best
    if abs(p.kp) < 1e-5:
        p.warnings.append("PidControllerPossiblyInManual")
    return p, sim


# Gain scheduling

def identify_gain_sched_given(y, u, dt, thresholds: list[float], index: int = 0, ignore=None, delays=True) -> tuple[GainSchedParameters, np.ndarray | None]:
    """One linear fit for each segment of the scheduling input, then the operating point by simulation.

    A segment is widened in steps of a fifth until it has half of the mean
    segment's range of excitation, or all of the data.
    """
    y, u = clean(y), clean(np.atleast_2d(np.asarray(u, float).T).T)
    x = u[:, index]
    low, high = np.nanmin(x), np.nanmax(x)
    edges = [low, *thresholds, high]
    mean_range = (high - low) / (len(edges) - 1)
    base = np.zeros(len(y), bool) if ignore is None else ignore
    gains, tcs, delay = [], [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        width = max(b - a, 1e-9)
        for widen in np.arange(0, 20.1, 0.2):
            inside = (x >= a - widen * width) & (x <= b + widen * width)
            if inside.any() and np.ptp(x[inside]) >= 0.5 * mean_range and inside.sum() >= 10:
                break
        p, _ = identify_unit(y, u, dt, ignore=base | ~inside, curvature=False, delays=delays)
        gains.append(p.gains)
        tcs.append(p.time_constant_s)
        delay.append(p.delay_s)
    g = GainSchedParameters([list(map(float, v)) for v in gains], list(map(float, thresholds)), [rounded(float(np.mean(tcs)))], [], float(np.median(delay)), rounded(float(np.nanmean(x))), 0.0, index)
    if len(set(map(lambda v: round(v, 6), tcs))) > 1 and len(thresholds) == 1:
        g.time_constants_s, g.tc_thresholds = [rounded(float(t)) for t in tcs], list(map(float, thresholds))
    return _anchored(g, y, u, dt, base)


def _anchored(g: GainSchedParameters, y, u, dt, base) -> tuple[GainSchedParameters, np.ndarray]:
    m = GainSchedModel("m", g, [f"u{i}" for i in range(u.shape[1])], "y")
    sim = simulate_single(m, [_filled(c) for c in u.T], dt)
    use = ~base & np.isfinite(y)
    g.operating_y = rounded(g.operating_y + float((y[use] - sim[use]).mean()))
    m = GainSchedModel("m", g, [f"u{i}" for i in range(u.shape[1])], "y")
    sim = simulate_single(m, [_filled(c) for c in u.T], dt)
    g.fitting = common(y, sim, use) | {"able": True}
    return g, sim


def identify_gain_sched(y, u, dt, index: int = 0, ignore=None, coarse: int = 40, fine: int = 20) -> tuple[GainSchedParameters, np.ndarray | None]:
    """One threshold, found on a coarse grid over the middle 70 % of the range, then a fine one around it."""
    y, u = clean(y), clean(np.atleast_2d(np.asarray(u, float).T).T)
    x = u[:, index]
    low, high = np.nanmin(x), np.nanmax(x)
    if high - low <= 0:
        return GainSchedParameters([[0.0] * u.shape[1]], [], fitting={"able": False}, warnings=["ConstantSchedulingInput"]), None
    span = high - low
    quick = lambda t: identify_gain_sched_given(y, u, dt, [float(t)], index, ignore, delays=False)
    error = lambda r: float(np.nansum(np.abs(y - r[1])))
    grid = np.linspace(low + 0.15 * span, high - 0.15 * span, coarse)
    first = min(((error(quick(t)), t) for t in grid), key=lambda e: e[0])[1]
    step = grid[1] - grid[0]
    second = min(((error(quick(t)), t) for t in np.linspace(first - step, first + step, fine)), key=lambda e: e[0])[1]
    return identify_gain_sched_given(y, u, dt, [float(second)], index, ignore)


# Disturbances and closed loops

def disturbance(y, u, model: UnitParameters, dt, ignore=None) -> np.ndarray:
    """d[k] = y[k] - process output one sample before (the same sample for the first)."""
    y, u = clean(y), clean(np.atleast_2d(np.asarray(u, float).T).T)
    proc = simulate_unit(model, np.column_stack([_filled(c) for c in u.T]), dt)
    d = _filled(y) - np.concatenate([proc[:1], proc[:-1]])
    if ignore is not None and ignore.any():
        d[ignore] = np.nan
        d = _filled(d)
    return d


@dataclass
class Candidate:
    gain: float
    model: UnitParameters
    d: np.ndarray
    scores: tuple[float, float, float, float] = field(default=(0.0, 0.0, 0.0, 0.0))


def closed_loop_candidate(y, yset, u, dt, pid: PidParameters, gain: float, tc: float, delay: float, pid_index: int, ignore) -> Candidate:
    """The disturbance that a gain implies, and how far it moves with what it should not depend on.

    v1: mean step of the PID output with the set point's part taken out,
    simulated without a disturbance; v2: correlation of the disturbance with
    the set point; v3: with external inputs; v4: mean step of the disturbance.
    """
    n, m = u.shape
    gains = [gain if i == pid_index else 0.0 for i in range(m)]
    if m > 1:
        gains = identify_with_fixed_gain(y, u, dt, pid_index, gain, float(u[0, pid_index]), ignore).gains
    model = UnitParameters(gains, float(y[0]), tc, delay, u0=[float(v) for v in u[0]], unorm=[1.0] * m)
    d = disturbance(y, u, model, dt, ignore)
    ideal = simulate_loop(model, pid, yset, u, dt, pid_index)
    moved = u[:, pid_index] - ideal
    corr = lambda a, b: 0.0 if np.ptp(a) == 0 or np.ptp(b) == 0 else abs(float(np.corrcoef(a, b)[0, 1]))
    v3 = sum(abs(float(np.cov(d, u[:, i])[0, 1])) for i in range(m) if i != pid_index)
    return Candidate(gain, model, d, (float(np.abs(np.diff(moved)).mean()), corr(d, yset), v3, float(np.abs(np.diff(d)).mean())))


def simulate_loop(model: UnitParameters, pid: PidParameters, yset, u, dt, pid_index: int = 0, d=None) -> np.ndarray:
    """PID output of the loop over the set point and external inputs, with a disturbance or none."""
    process = UnitModel("process", model, [f"u{i}" for i in range(u.shape[1])], "y")
    c = PidController(pid, dt)
    rest = [float(v) for v in u[0]]
    proc = process.step(rest, dt)[0]
    start = process.steady_input(float(yset[0]) - (float(d[0]) if d is not None else 0.0), pid_index, rest)
    out = np.zeros(len(yset))
    if start is not None:
        rest[pid_index] = start
        process.reset()
        proc = process.step(rest, dt)[0]
    c.warm_start(float(yset[0]), float(yset[0]), rest[pid_index])
    for k in range(len(yset)):
        y = proc + (float(d[k]) if d is not None else 0.0)
        out[k] = c.step(y, float(yset[k]))
        row = [float(v) for v in u[k]]
        row[pid_index] = out[k]
        proc = process.step(row, dt)[0]
    return out


def strength(v: np.ndarray) -> tuple[float, int]:
    """How deep an inner minimum is, in percent of its higher neighbour; 0 at the ends."""
    i = int(np.argmin(v))
    if i in (0, len(v) - 1):
        return 0.0, i
    beside = max(v[i - 1], v[i + 1])
    return (100 * (1 - v[i] / beside) if beside > 0 else 0.0), i


def choose(found: list[Candidate], weak: float = 0.2, none: float = 0.001) -> Candidate | None:
    """The least v1; where that is flat, with v2 and v3 added; where all are, the least v4."""
    v = np.array([c.scores for c in found]).T
    s = [strength(x) for x in v]
    if all(x[0] < none for x in s[:3]):
        return found[s[3][1]] if s[3][0] > 0 else None
    objective = v[0].copy()
    if s[0][0] < weak:
        scaled = lambda x: (x - x.min()) / np.ptp(x) if np.ptp(x) > 0 else x * 0
        for j in (1, 2):
            if v[j].any() and s[j][0] > 0:
                objective = objective + scaled(v[j])
    return found[int(np.argmin(objective))]


def identify_closed_loop(y, yset, u, dt, pid: PidParameters, pid_index: int = 0, ignore=None) -> tuple[UnitParameters, np.ndarray]:
    """Process model and disturbance from closed-loop data with a known PID.

    A model-free gain starts the search; passes of a gain grid that
    narrows follow, each followed by a scan of time constants that makes the
    disturbance smoothest.
    """
    y, yset = _filled(clean(y)), _filled(clean(yset))
    u = np.column_stack([_filled(c) for c in clean(np.atleast_2d(np.asarray(u, float).T).T).T])
    moved, e = np.abs(u[:, pid_index] - u[0, pid_index]), np.abs(y - yset)
    sign = 1.0 if pid.kp >= 0 else -1.0
    spread = moved.max() - moved.min()
    gain = sign * (e.max() / spread if spread > 0 else 1.0)
    top = 0.98 / abs(pid.kp) if pid.kp else math.inf
    if abs(gain) > top:
        gain = sign * top * 0.97
    # A step of the disturbance is answered by the integral until gain du = -d, which the final change shows.
    final = abs(u[-1, pid_index] - u[0, pid_index])
    if np.ptp(yset) > 0 and final > 1e-6:
        gain = sign * min(top, max(abs(gain), abs(yset[-1] - yset[0]) / final) or abs(gain))
    # A bracket around the gain, at first up to 2.5 times of it and down to 0.4 of it, is narrowed to its cube root each time.
    tc, best, bracket = 0.0, None, 2.5
    while bracket > 1.03:
        grid = np.geomspace(abs(gain) / bracket, min(abs(gain) * bracket, top), 15)
        found = [closed_loop_candidate(y, yset, u, dt, pid, sign * float(g), tc, 0.0, pid_index, ignore) for g in grid if g > 0]
        chosen = choose(found) if len(found) > 2 else None
        if chosen is None:
            # Flat: match the largest slow to the largest fast part of the disturbance.
            chosen = best or min(found, key=lambda c: abs(np.abs(c.d - c.d[0]).max() - np.abs(np.diff(c.d)).max()))
            best = chosen
            break
        best, gain = chosen, chosen.gain
        scan = [(float(np.abs(np.diff(disturbance(y, u, _with_tc(best.model, t * dt), dt, ignore))).mean()), t * dt) for t in range(0, 61, 4 if bracket > 1.2 else 1)]
        tc = min(scan)[1]
        best.model, bracket = _with_tc(best.model, tc), bracket ** (1 / 3)
    model = best.model
    model.gains, model.time_constant_s = rounded(model.gains), rounded(tc)
    d = disturbance(y, u, model, dt, ignore)
    model.fitting = {"able": True, "fit_score_prc": rounded(fit_score(u[:, pid_index], simulate_loop(model, pid, yset, u, dt, pid_index, d)))}
    return model, d


def _with_tc(p: UnitParameters, tc: float) -> UnitParameters:
    return UnitParameters(list(p.gains), p.bias, tc, p.delay_s, u0=p.u0, unorm=p.unorm)


def per_series(df: DataFrame, estimate: Callable[[pd.DataFrame], object], columns: list[str]) -> DataFrame:
    """series_id, kind, able, fit_score, params (JSON): an estimator over each series, in order of k."""
    kind = df.schema["series_id"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = estimate(pdf.sort_values("k"))
        score = p.fitting.get("fit_score_prc")
        return pd.DataFrame({
            "series_id": [key[0]], "kind": [type(p).__name__], "able": [bool(p.fitting.get("able"))],
            "fit_score": [None if score is None or not np.isfinite(score) else float(score)], "params": [json.dumps(asdict(p))],
        })

    return df.select("series_id", "k", *columns).groupBy("series_id").applyInPandas(one, f"series_id {kind}, kind string, able boolean, fit_score double, params string")


__all__ = ["FittingSpecs", "identify_unit", "identify_pid", "identify_gain_sched", "identify_gain_sched_given", "identify_closed_loop", "disturbance", "per_series", "PidModel"]
