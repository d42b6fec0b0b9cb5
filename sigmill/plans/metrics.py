"""Fit metrics of a simulated against a measured series."""

from __future__ import annotations

import numpy as np


def rounded(x, digits: int = 5):
    """To so many significant digits; arrays and None pass."""
    if x is None:
        return None
    if np.ndim(x):
        return [rounded(v, digits) for v in x]
    return float(f"%.{digits - 1}e" % x) if np.isfinite(x) else float(x)


def fit_score(measured: np.ndarray, simulated: np.ndarray, good: np.ndarray | None = None, skip: int = 2) -> float:
    """100 (1 - mean |error| / mean |measured - mean|); the first samples are skipped in the deviations."""
    good = np.isfinite(measured) & np.isfinite(simulated) & (True if good is None else good)
    if not good.any():
        return float("nan")
    mean = measured[good].mean()
    use = good.copy()
    use[:skip] = False
    around = np.abs(measured[use] - mean).mean() if use.any() else 0.0
    error = np.abs(measured[use] - simulated[use]).mean() if use.any() else 0.0
    return 100 * (1 - error / around) if around > 0 else (100.0 if error == 0 else 0.0)


def r_squared(model: np.ndarray, measured: np.ndarray) -> float:
    """The total sum is that of the model around the mean of the measurements."""
    total = ((model - measured.mean()) ** 2).sum()
    return 1 - ((measured - model) ** 2).sum() / total if total > 0 else 0.0


def common(measured: np.ndarray, simulated: np.ndarray, good: np.ndarray) -> dict[str, float]:
    """fit_score_prc, rsq_diff and obj_diff, the last two on differences of good neighbours."""
    pairs = good[1:] & good[:-1] & np.isfinite(measured[1:] - measured[:-1])
    dm, ds = np.diff(measured)[pairs], np.diff(simulated)[pairs]
    some = len(dm) > 0
    return {
        "fit_score_prc": rounded(fit_score(measured, simulated, good)),
        "rsq_diff": rounded(100 * r_squared(ds, dm)) if some else 0.0,
        "obj_diff": rounded(float(np.abs(dm - ds).mean())) if some else 0.0,
    }
