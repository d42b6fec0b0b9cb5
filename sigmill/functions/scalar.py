"""Element-wise column functions.

Missing values are NULL after ``clean``; every function passes NULL on
unless it says otherwise.  `compat` brings back what the original library
does with missing values where that differs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD = -9999.0


def clean(x: Column, bad: float = BAD) -> Column:
    """NULL where the value is NaN or the bad-data id."""
    return F.when(F.isnan(x) | (x == bad), None).otherwise(x)


def absolute(x: Column) -> Column:
    return F.abs(x)


def add(a: Column, b: Column | float) -> Column:
    return a + b


def subtract(a: Column, b: Column | float, compat: bool = False) -> Column:
    """a - b; with `compat` a missing element gives 0."""
    return F.coalesce(a - b, F.lit(0.0)) if compat else a - b


def multiply(a: Column, b: Column | float) -> Column:
    return a * b


def divide(a: Column, b: Column | float) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b if isinstance(b, Column) else F.lit(float(b)))


def power(x: Column, p: float) -> Column:
    return F.pow(x, F.lit(float(p)))


def larger(a: Column, b: Column) -> Column:
    """a where a > b, else b: a missing a gives b, a missing b gives b."""
    return F.when(a > b, a).otherwise(b)


def smaller(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def at_least(x: Column, low: float, compat: bool = False) -> Column:
    out = F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))
    return F.coalesce(out, F.lit(0.0)) if compat else out


def at_most(x: Column, high: float, compat: bool = False) -> Column:
    out = F.when(x.isNotNull(), F.least(x, F.lit(float(high))))
    return F.coalesce(out, F.lit(0.0)) if compat else out


def replace_where(x: Column, flag: Column, value: float) -> Column:
    return F.when(flag, F.lit(float(value))).otherwise(x)


def replace_above(x: Column, limit: float, value: float) -> Column:
    return replace_where(x, x > limit, value)


def replace_below(x: Column, limit: float, value: float) -> Column:
    return replace_where(x, x < limit, value)


def replace_outside(x: Column, low: float, high: float, value: float) -> Column:
    return replace_where(x, (x < low) | (x > high), value)


def significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x)).cast("double")


def scientific(x: Column, digits: int) -> Column:
    """struct(coefficient, exponent) of the scientific form."""
    parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    return F.struct(parts[0].cast("double").alias("coefficient"), parts[1].cast("int").alias("exponent"))


def array_text(values: Column, digits: int, separator: str = ";") -> Column:
    """[a;b;c] of an array of doubles, to so many significant digits; missing ones are NaN."""
    one = F.transform(values, lambda v: F.coalesce(significant(v, digits).cast("string"), F.lit("NaN")))
    return F.concat(F.lit("["), F.array_join(one, separator), F.lit("]"))


def parse_number(text: Column) -> Column:
    """A number with decimal comma or point; NULL where it is none."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def scale_y(y: Column, low: float, high: float) -> Column:
    """Share of the range, not percent."""
    return (y - low) / F.lit(float(high - low))


def range_factor(low: float, high: float, on: bool) -> float:
    return 100.0 / (high - low) if on and high > low else 1.0


def kp_factor(y: tuple[float, float], u: tuple[float, float], on: bool) -> float:
    return range_factor(*u, on) / range_factor(*y, on)


def scheduled(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation between four (x, y) points; the outer pieces extend to both sides."""
    (xa, ya), (xb, yb), (xc, yc), (xd, yd) = points
    line = lambda x0, y0, x1, y1: (x - x0) * ((y1 - y0) / (x1 - x0)) + y0
    return F.when(x < xb, line(xa, ya, xb, yb)).when(x > xc, line(xc, yc, xd, yd)).otherwise(line(xb, yb, xc, yc))


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def from_unix(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1e6).cast("long")).cast("timestamp_ntz")


def signal_name(model: Column, kind: Column, index: Column | None = None) -> Column:
    """<model>-<kind>, or <model>-<kind>-<index>."""
    return F.concat_ws("-", model, kind, index.cast("string")) if index is not None else F.concat_ws("-", model, kind)


def disturbance_name(model: Column) -> Column:
    return F.concat(F.lit("_D_"), model)


def integrated_gain(start: float, end: Column, thresholds: list[float], gains: list[float]) -> Column:
    """Integral of a gain that is constant between thresholds, from `start` to `end`."""
    edges = [None, *thresholds, None]
    total = F.lit(0.0)
    for low, high, gain in zip(edges[:-1], edges[1:], gains, strict=True):
        def inside(v: Column) -> Column:
            v = v if low is None else F.greatest(v, F.lit(float(low)))
            return v if high is None else F.least(v, F.lit(float(high)))
        total = total + (inside(end) - inside(F.lit(float(start)))) * gain
    return F.when(end.isNotNull(), total)


def steady_state(inputs: list[Column], bias: float, gains: list[float], u0: list[float] | None = None, curvatures: list[float] | None = None, unorm: list[float] | None = None) -> Column:
    """Output of a static unit model: bias + gain (u - u0) + curvature (u - u0)^2 / unorm, summed."""
    out = F.lit(float(bias))
    for i, u in enumerate(inputs):
        d = u - (u0[i] if u0 else 0.0)
        out = out + d * gains[i]
        if curvatures:
            out = out + d * d * (curvatures[i] / (unorm[i] if unorm else 1.0))
    return out


def steady_input(y: Column, bias: float, gain: float, u0: float = 0.0, curvature: float = 0.0, unorm: float = 1.0) -> Column:
    """The input at which a one-input unit model is at `y`: the smaller root, or -b/2a where there is none."""
    rest = y - bias
    if not curvature:
        return rest / gain + u0
    a = curvature / unorm
    square = gain * gain + 4 * a * rest
    root = lambda sign: (-gain + sign * F.sqrt(F.greatest(square, F.lit(0.0)))) / (2 * a)
    return F.when(square > 0, F.least(root(1), root(-1))).when(square <= 0, -gain / (2 * a)) + u0


def select(inputs: list[Column], kind: str) -> Column:
    """Row-wise MIN or MAX of the inputs that are there."""
    return inputs[0] if len(inputs) == 1 else (F.least if kind == "MIN" else F.greatest)(*inputs)


def divide_model(a: Column, b: Column, factor: float = 1.0, low: float | None = None, high: float | None = None, bad: float = BAD) -> Column:
    """factor a / b within limits; `bad` where an input is missing or b is zero."""
    out = F.try_divide(a, b) * factor
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    return F.coalesce(out, F.lit(float(bad)))
