"""Queries of windows, filters, dataset verbs, detectors, regression and correlation."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import reductions as R
from ..operators import dataset as D
from ..operators import ordered as N
from ..operators import quality as Q
from ..operators import recursive as C
from ..operators import regression as G
from ..operators import series as O
from ..operators import spectrum as S
from ..operators import thresholds as H
from .base import EVENTS, PAIRS, events, pairs, r, table


def windows(spark, d):
    x, w, block = F.col("x"), N.B(), 24
    rows = N.haloed(N.held(events(spark, d), x, x > 80, "held", block), 4, 3, block)
    out = rows.select(
        "series_id", "k", "_b", r(O.moving_average(x, 5, w)).alias("moving"), r(O.smooth(x, 3, w)).alias("smooth"), r(O.difference(x, w)).alias("diff"),
        r(O.delayed(x, 3, w)).alias("delayed"), r(F.col("held")).alias("held"),
    )
    return N.own(out, block)


WINDOWS = f"""with {EVENTS}, q as (select *, count(*) over (partition by series_id) as n from s)
select series_id, k, round(case when count(x) over m = count(*) over m then avg(x) over m end, 6) as moving,
round(case when k < 3 or k >= n - 3 then x else avg(x) over c end, 6) as smooth, round(case when k = 0 then 0 else x - lag(x) over w end, 6) + 0.0 as diff,
round(case when k < 3 then x else lag(x, 3) over w end, 6) as delayed,
round(last_value(case when x > 80 and k > 0 then null else x end ignore nulls) over (partition by series_id order by k rows between unbounded preceding and current row), 6) as held from q
window w as (partition by series_id order by k), m as (partition by series_id order by k rows between 4 preceding and current row),
c as (partition by series_id order by k rows between 3 preceding and 3 following)"""

_FILLED = """f as (select series_id, k, coalesce(last_value(x ignore nulls) over (partition by series_id order by k rows between unbounded preceding and current row),
  first_value(x ignore nulls) over (partition by series_id order by k rows between current row and unbounded following)) as x from s)"""


def low_pass(spark, d):
    out = C.low_pass(events(spark, d), 5.0)
    return out.select("series_id", "k", r(F.col("y")).alias("y"), r(F.col("x") - F.col("y")).alias("high"))


LOW_PASS = f"""with recursive {EVENTS}, {_FILLED}, g as (select 0::bigint as k, series_id, x as y from f where k = 0
 union all select f.k, f.series_id, g.y * (1 / (1 + 1 / 5.0::double)) + f.x * (1 - 1 / (1 + 1 / 5.0::double)) from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select g.series_id, g.k, round(g.y, 6) as y, round(s.x - g.y, 6) + 0.0 as high from g join s on s.series_id = g.series_id and s.k = g.k"""


def low_pass_blocks(spark, d):
    filled = events(spark, d).withColumn("x", F.coalesce("x", F.lit(50.0)))
    return C.low_pass(filled, 5.0, block=16).select("series_id", "k", r(F.col("y")).alias("y"))


LOW_PASS_BLOCKS = f"""with recursive {EVENTS}, f as (select series_id, k, coalesce(x, 50) as x from s), g as (select 0::bigint as k, series_id, x as y from f where k = 0
 union all select f.k, f.series_id, g.y * (1 / (1 + 1 / 5.0::double)) + f.x * (1 - 1 / (1 + 1 / 5.0::double)) from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select series_id, k, round(y, 6) as y from g"""


def low_pass_twice(spark, d):
    return C.low_pass(events(spark, d), 5.0, order=2, block=16).select("series_id", "k", r(F.col("y")).alias("y"))


LOW_PASS_TWICE = f"""with recursive {EVENTS}, {_FILLED}, g as (select 0::bigint as k, series_id, x as y, 0::double as i from f where k = 0
 union all select f.k, f.series_id, g.y / 1.2::double + (g.i / 1.2::double + f.x * (1 - 1 / 1.2::double)) * (1 - 1 / 1.2::double), g.i / 1.2::double + f.x * (1 - 1 / 1.2::double)
 from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select series_id, k, round(y, 6) as y from g"""


def band_pass(spark, d):
    out = C.linear(events(spark, d), C.band_pass_of(2.0, 8.0))
    return out.select("series_id", "k", r(F.col("y")).alias("y"))


BAND_PASS = f"""with recursive {EVENTS}, {_FILLED}, g as (select 0::bigint as k, series_id, x as a, x as b from f where k = 0
 union all select f.k, f.series_id, g.a / 1.5::double + f.x * (1 - 1 / 1.5::double), g.b / 1.125::double + f.x * (1 - 1 / 1.125::double)
 from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select g.series_id, g.k, round(f.x - g.a - (f.x - g.b), 6) + 0.0 as y from g join f on f.series_id = g.series_id and f.k = g.k"""


def second_order(spark, d):
    out = C.linear(events(spark, d), C.second_order_of(6.0, 0.4))
    return out.select("series_id", "k", r(F.col("y")).alias("y"))


SECOND_ORDER = f"""with recursive {EVENTS}, {_FILLED}, o as (select 2 / 6.0::double as w, 1 + 0.8::double * 2 / 6 + (2 / 6.0::double) * (2 / 6.0::double) as v),
c as (select (2 + 0.8::double * w) / v as a1, -1 / v as a2 from o),
g as (select 0::bigint as k, series_id, x as y, x as p from f where k = 0
 union all select f.k, f.series_id, case when f.k = 1 then f.x else a1 * g.y + a2 * g.p + (1 - a1 - a2) * f.x end, case when f.k = 1 then f.x else g.y end
 from g join f on f.series_id = g.series_id and f.k = g.k + 1, c)
select series_id, k, round(y, 6) as y from g"""


def running_mean(spark, d):
    out = C.recursive_average(events(spark, d), block=32)
    return out.select("series_id", "k", r(F.col("y"), 9).alias("y"))


RUNNING_MEAN = f"""with {EVENTS} select series_id, k, round(coalesce(avg(x) over (partition by series_id order by k rows between unbounded preceding and current row), 0), 9) as y from s"""


def fit_score(spark, d):
    """How well the low-passed series fits the raw one; the first two samples are skipped in the deviations."""
    y = C.low_pass(events(spark, d), 5.0)
    means = y.groupBy(F.col("series_id").alias("_s")).agg(F.avg("x").alias("m"))
    m = y.where("k >= 2").join(means, F.col("series_id") == F.col("_s"))
    return m.groupBy("series_id").agg(
        r(100 * (1 - F.try_divide(F.avg(F.abs(F.col("x") - F.col("y"))), F.avg(F.abs(F.col("x") - F.col("m"))))), 4).alias("fit_score"),
        r(R.r_squared(F.col("y"), F.col("x")), 5).alias("r_squared"),
    )


FIT_SCORE = f"""with recursive {EVENTS}, {_FILLED}, g as (select 0::bigint as k, series_id, x as y from f where k = 0
 union all select f.k, f.series_id, g.y * (1 / (1 + 1 / 5.0::double)) + f.x * (1 - 1 / (1 + 1 / 5.0::double)) from g join f on f.series_id = g.series_id and f.k = g.k + 1),
t as (select g.series_id, g.k, g.y, s.x, avg(s.x) over (partition by g.series_id) as m from g join s on s.series_id = g.series_id and s.k = g.k)
select series_id, round(100 * (1 - avg(abs(x - y)) / nullif(avg(abs(x - m)), 0)), 4) as fit_score,
round(1 - avg((x - y) * (x - y)) / (var_pop(y) filter (where x is not null) + pow(avg(y) filter (where x is not null) - avg(x), 2)), 5) as r_squared
from t where k >= 2 group by series_id"""


def downsampled(spark, d):
    return O.downsample_good(events(spark, d), 4, F.col("x").isNull() | (F.col("x") > 90)).select("series_id", "block", "k", r(F.col("x")).alias("x"), "flagged")


DOWNSAMPLED = f"""with {EVENTS}, b as (select *, x is null or x > 90 as bad from s), w as (select series_id, coalesce(min(k) filter (where not bad and k < 4), 3) as key, max(k) as last from b group by 1),
g as (select b.*, ceil((k - key) / 4.0::double)::bigint as block, key, last from b join w using (series_id)),
f as (select * from g where block >= 0 and key + block * 4 <= last and (block > 0 or k = key)),
c as (select series_id, block, max_by(k, k) filter (where not coalesce(bad, false)) as gk, max_by(coalesce(x, -1e9), k) filter (where not coalesce(bad, false)) as gx, max(k) as ok, max_by(coalesce(x, -1e9), k) as ox from f group by all)
select series_id, block, coalesce(gk, ok) as k, round(nullif(case when gk is null then ox else gx end, -1e9), 6) as x, gk is null as flagged from c"""


def oversampled(spark, d):
    """At every hour from that of the first sample of all series to the last sample."""
    ev = events(spark, d)
    low, high = (v.replace(tzinfo=None) for v in ev.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz"), F.max("ts").cast("timestamp_ntz")).first())
    out = O.on_grid(ev, low, high, timedelta(hours=1), block=64)
    return out.select("series_id", "ts", F.coalesce("k_before", F.lit(-1)).alias("k_before"), r(F.col("x_before")).alias("x_before"), "k_after")


OVERSAMPLED = f"""with {EVENTS}, e as (select * from s), h as (select date_trunc('hour', min(ts))::timestamp as low, max(ts)::timestamp as high from s),
n as (select unnest(generate_series(low, high, interval 1 hour)) as ts from h), g as (select series_id, ts from (select distinct series_id from e), n),
b as (select g.series_id, g.ts, e.k, e.x from g asof left join e on g.series_id = e.series_id and g.ts >= e.ts),
a as (select g.series_id, g.ts, e.k from g asof left join e on g.series_id = e.series_id and g.ts <= e.ts),
l as (select series_id, max(k) as k from e group by 1)
select b.series_id, b.ts, coalesce(b.k, -1) as k_before, round(b.x, 6) as x_before, coalesce(a.k, l.k) as k_after from b join a on a.series_id = b.series_id and a.ts = b.ts join l on l.series_id = b.series_id"""


def index_at(spark, d):
    ev = events(spark, d)
    when = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    days = O.subset_days(ev, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 3, 2).groupBy("series_id").agg(F.count("*").alias("n_days"))
    return O.index_at(ev, when).join(O.index_at(ev, when, True).withColumnRenamed("k", "k_compat"), "series_id").join(days, "series_id", "left").select("series_id", "k", "k_compat", F.coalesce("n_days", F.lit(0)).alias("n_days"))


INDEX_AT = f"""with {EVENTS}, m as (select series_id, max(k) filter (where ts <= timestamp '2024-01-15 12:00:00') as m,
count(*) filter (where ts between timestamp '2024-01-15' and timestamp '2024-01-18') as n_days from s group by 1)
select series_id, greatest(coalesce(m, 0), 0) as k, greatest(coalesce(m - 1, 0), 0) as k_compat, n_days from m"""


def _waves(spark, d):
    """Each user's samples on top of a wave whose period follows from the user."""
    swing = F.sin(F.col("k") * (2 * math.pi) / (4 + F.col("series_id") % 7)) * (F.col("series_id") % 3 * 60)
    return events(spark, d).withColumn("x", F.coalesce("x", F.lit(0.0)) + swing)


def period(spark, d):
    return S.periods(_waves(spark, d), 2.0, block=16).select("series_id", r(F.col("period_s")).alias("period_s"))


_WAVES = f"z as (select series_id, k, coalesce(x, 0) + sin(k * (2 * pi()) / (4 + series_id % 7)) * (series_id % 3 * 60) as x from s), l as (select series_id, (1::bigint << floor(log2(max(k) + 1) + 1e-9)::int) as n from z group by 1)"
_DFT = """t as (select series_id, n, bin, sum(x * cos(2 * pi() * ((bin * k) % n) / n)) as re, -sum(x * sin(2 * pi() * ((bin * k) % n) / n)) as im from z join l using (series_id), lateral (select unnest(range(n)) as bin) where k < n group by all)"""
PERIOD = f"""with {EVENTS}, {_WAVES}, {_DFT}, a as (select series_id, sum(abs(x)) as total from z group by 1),
m as (select series_id, n, bin, case when sqrt(re * re + im * im) > 1e-9 * greatest(total, 1) then sqrt(re * re + im * im) else 0 end as m from t join a using (series_id) where bin > 0 and bin < n / 2),
o as (select *, row_number() over w - 1 as place, lead(m) over w as next from m window w as (partition by series_id order by m desc, bin)),
e as (select * from o where next < 0.7::double * m qualify row_number() over (partition by series_id order by place) = 1)
select series_id, round(case when place <= floor((n / 2 - 1) * 0.3::double) and bin > 1 then 2 * n / bin end, 6) as period_s from (select distinct series_id from z) left join e using (series_id)"""


def spectrum(spark, d):
    return S.fourier(_waves(spark, d)).select("series_id", "n", "bin", r(F.col("re"), 4).alias("re"), r(F.col("im"), 4).alias("im"))


SPECTRUM = f"with {EVENTS}, {_WAVES}, {_DFT} select series_id, n, bin, round(re, 4) + 0.0 as re, round(im, 4) + 0.0 as im from t"


def _daily(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    od = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n_orders"))
    return li, od


def time_join(spark, d):
    li, od = _daily(spark, d)
    return D.join_on_time(li, od).select("ts", r(F.col("quantity"), 2).alias("quantity"), r(F.col("discount")).alias("discount"), r(F.col("total"), 2).alias("total"), "n_orders")


_DAILY = """l as (select l_shipdate as ts, sum(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by 1),
o as (select o_orderdate as ts, sum(o_totalprice) as total, count(*) as n_orders from orders group by 1)"""
TIME_JOIN = f"with {_DAILY} select ts, round(quantity, 2) as quantity, round(discount, 6) as discount, round(total, 2) as total, n_orders from l join o using (ts)"


def combined(spark, d):
    ev = events(spark, d)
    other = ev.where("k < 10").withColumn("y", F.col("x") * 2).withColumn("x", F.lit(0.0))
    both = D.with_constant(D.combine(ev, other.select("series_id", "k", "x", "y")), c=5)
    return both.select("series_id", "k", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "c")


COMBINED = f"with {EVENTS} select series_id, k, round(x, 6) as x, round(case when k < 10 then x * 2 end, 6) as y, 5.0::double as c from s"


def concatenated(spark, d):
    ev = events(spark, d)
    both = O.concat(ev, ev.where("k < 3"))
    more = ev.where("k < 2").withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(60))).unionByName(ev.where("k = 1"))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.max("k").alias("last"), F.countDistinct("k").alias("places")).join(
        O.appended(ev, more).groupBy("series_id").agg(F.count("*").alias("appended"), F.max("k").alias("last_appended")), "series_id"
    )


CONCATENATED = f"""with {EVENTS}, n as (select series_id, count(*) as n from s group by 1)
select series_id, n + least(n, 3) as n, n + least(n, 3) - 1 as last, n + least(n, 3) as places, n + least(n, 2) as appended, n + least(n, 2) - 1 as last_appended from n"""


#: The signals of the events, as they are described.
TYPES = ["click", "error", "purchase", "signup", "view"]


def wide_long(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("date").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("signal"), F.col("value").alias("x"))
    daily = rows.groupBy("series_id", "ts", "signal").agg(F.max("x").alias("x"))
    return D.long(D.wide(daily, TYPES), TYPES).where("x is not null").select("series_id", "ts", "signal", r(F.col("x")).alias("x"))


WIDE_LONG = """select user_id as series_id, date_trunc('day', ts)::timestamp as ts, event_type as signal, round(max(value), 6) as x from events
where event_type is not null and value is not null group by all"""


def summarised(spark, d):
    return D.summary(pairs(spark, d), ["a", "b", "c"]).select("signal", "n", "n_missing", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))


SUMMARISED = f"with {PAIRS} " + " union all ".join(f"select '{c}' as signal, count({c}) as n, count(*) - count({c}) as n_missing, round(min({c}), 6) as low, round(max({c}), 6) as high from p" for c in "abc")


def bad_data(spark, d):
    ev = events(spark, d).withColumn("y", F.when(F.col("k") % 13 == 0, None).otherwise(F.round("x", -1)))
    out = Q.with_frozen(Q.ignored(ev, ["x", "y"], given=F.col("k").isin(0, 20), block=16), ["y"], "frozen", 16)
    return out.select("series_id", "k", Q.bad(["x", "y"]).alias("bad"), "frozen", "ignore", Q.outside("x", 10, 90).alias("outside"))


BAD_DATA = f"""with {EVENTS}, q as (select *, case when k % 13 = 0 then null else round(x, -1) end as y from s),
p as (select *, lag(x) over w as px, lag(y) over w as py, x is null or y is null as bad, k in (0, 20) as given, lead(k in (0, 20)) over w as next_given from q window w as (partition by series_id order by k)),
t as (select *, coalesce(lag(bad) over (partition by series_id order by k), false) as prev_bad from p)
select series_id, k, bad, coalesce(y = py, false) as frozen, bad or prev_bad or given or coalesce(next_given, false) or k = 1 or (coalesce(x = px, false) and coalesce(y = py, false)) as ignore,
coalesce(x < 10 or x > 90, false) as outside from t"""


def frozen_runs(spark, d):
    ev = events(spark, d).withColumn("y", F.floor(F.col("k") / 3).cast("double"))
    whole = Q.without_frozen(ev, ["y"], 16).groupBy("series_id").agg(F.count("*").alias("n_left"))
    factor = Q.oversampled_factor(ev, ["y"], 16).select("series_id", r(F.col("factor")).alias("factor"), F.col("key").cast("long").alias("key"))
    return Q.frozen_runs(ev, ["y"], 16).join(whole, "series_id").join(factor, "series_id")


FROZEN_RUNS = f"""with {EVENTS}, n as (select series_id, count(*) as n from s group by 1 having count(*) > 6),
c as (select *, n - ceil(n / 3.0)::bigint as repeats from n)
select series_id, repeats::bigint as n_frozen, 2::bigint as mean_run, 2::bigint as min_run, n - repeats as n_left,
round(case when ceil(n / (n - repeats)::double) = 3 then n / (n - repeats)::double else 1 end, 6) as factor, case when ceil(n / (n - repeats)::double) = 3 then 3 else 0 end::bigint as key from c"""


def unit_factor(spark, d):
    """Output and input held for 1 to 4 samples each, with two flat stretches that both share and one of the output alone."""
    hold = F.col("k") - F.col("k") % (F.col("series_id") % 4 + 1)
    flat = F.when(F.col("k").between(20, 33), 20).when(F.col("k").between(45, 55), 45)
    ev = events(spark, d).withColumns({"y": F.coalesce(flat, F.when(F.col("k").between(10, 14), 10), hold).cast("double"), "u": -F.coalesce(flat, hold).cast("double")})
    out = Q.unit_oversampled_factor(ev, "y", ["u"], block=16)
    return out.select("series_id", r(F.col("factor")).alias("factor"), F.col("key").cast("long").alias("key"), "n_flat")


UNIT_FACTOR = f"""with {EVENTS}, h as (select series_id, k, k - k % (series_id % 4 + 1) as hold, case when k between 20 and 33 then 20 when k between 45 and 55 then 45 end as flat from s),
z as (select series_id, k, coalesce(flat, case when k between 10 and 14 then 10 end, hold) as y, coalesce(flat, hold) as u from h),
f as (select *, k > 0 and y = lag(y) over w and u = lag(u) over w as same from z window w as (partition by series_id order by k)),
g as (select series_id, k, k - row_number() over (partition by series_id order by k) as island from f where same), q as (select series_id, island, min(k) as first, count(*) as length from g group by all),
m as (select series_id, quantile_disc(length, 0.5) as m from q group by 1), t as (select *, length > m + 2 as is_flat from q join m using (series_id)),
o as (select series_id, sum(length)::bigint as total, coalesce(sum(length) filter (where is_flat), 0)::bigint as gone, count(*) filter (where is_flat) as n_flat, max(length) filter (where not is_flat) as longest, min(first) filter (where not is_flat) as begin from t group by 1),
n as (select series_id, count(*) as n from s group by 1), p as (select *, (n - gone) / (n - total)::double as plain from n left join o using (series_id)),
v as (select *, case when n_flat = 0 then plain else (n - (gone - n_flat * plain)) / (n - total) end as f from p),
w as (select *, coalesce(total >= 2 and f > 1 and case when n_flat = 0 then longest + 1 = ceil(f) else longest between floor(f) - 1 and ceil(f) + 1 end, false) as fine from v)
select series_id, round(case when fine then f else 1 end, 6) as factor, case when fine then begin - 1 else 0 end::bigint as key, coalesce(n_flat, 0)::bigint as n_flat from w"""


def regression(spark, d):
    p = pairs(spark, d)
    fit = G.regress(p, F.col("c"), [F.col("a"), F.col("b")])
    return fit.select("series_id", "n", "able", r(F.col("params")[0], 4).alias("p0"), r(F.col("params")[1], 4).alias("p1"), r(F.col("bias"), 4).alias("bias"), r(F.col("rsq"), 4).alias("rsq"))


REGRESSION = f"""with {PAIRS}, m as (select series_id, count(*) as n, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, c) as ac, covar_pop(b, c) as bc,
avg(a) as ma, avg(b) as mb, avg(c) as mc, var_pop(c) as cc from p group by 1),
t as (select *, (ac * bb - bc * ab) / (aa * bb - ab * ab) as p0, (bc * aa - ac * ab) / (aa * bb - ab * ab) as p1 from m)
select series_id, n, true as able, round(p0, 4) as p0, round(p1, 4) as p1, round(mc - p0 * ma - p1 * mb, 4) as bias, round(100 * (p0 * ac + p1 * bc) / cc, 4) as rsq from t"""


def ridge(spark, d):
    """The second of two inputs, which is scaled up so that its weight tells, is drawn towards 0."""
    fit = G.regress(pairs(spark, d), F.col("c"), [F.col("a"), F.col("b") * 10], regularise=[1])
    return fit.select(
        "series_id", "n", "able", "rank_deficient", r(F.col("params")[0], 4).alias("p0"), r(F.col("params")[1], 4).alias("p1"), r(F.col("bias"), 4).alias("bias"),
        r(F.col("rsq"), 4).alias("rsq"), r(F.col("ci95")[0], 4).alias("ci0"), r(F.col("ci95")[1], 4).alias("ci1"), r(F.col("ci95")[2], 4).alias("ci_bias"),
    )


RIDGE = f"""with {PAIRS}, m as (select series_id, count(*) as n, regr_sxx(a, a) as aa, regr_sxx(10 * b, 10 * b) + count(*) / 1000.0::double as bw, regr_sxx(10 * b, 10 * b) as bb,
 regr_sxy(a, 10 * b) as ab, regr_sxy(a, c) as ac, regr_sxy(10 * b, c) as bc, regr_sxx(c, c) as cc, avg(a) as ma, avg(10 * b) as mb, avg(c) as mc from p group by 1),
t as (select *, aa * bw - ab * ab as det, (ac * bw - bc * ab) / (aa * bw - ab * ab) as p0, (bc * aa - ac * ab) / (aa * bw - ab * ab) as p1 from m),
e as (select *, cc - 2 * (p0 * ac + p1 * bc) + p0 * p0 * aa + 2 * p0 * p1 * ab + p1 * p1 * bb as sse from t)
select series_id, n, true as able, false as rank_deficient, round(p0, 4) + 0.0 as p0, round(p1, 4) + 0.0 as p1, round(mc - p0 * ma - p1 * mb, 4) + 0.0 as bias, round(100 * (1 - sse / cc), 4) + 0.0 as rsq,
round(1.96 * sqrt(bw / det * sse / greatest(1, n - 3)), 4) as ci0, round(1.96 * sqrt(aa / det * sse / greatest(1, n - 3)), 4) as ci1,
round(1.96 * sqrt((1 / n::double + (ma * ma * bw - 2 * ma * mb * ab + mb * mb * aa) / det) * sse / greatest(1, n - 3)), 4) as ci_bias from e"""


def offset_regression(spark, d):
    """The fit of `c` to `a` and `b` where both stand at an offset of 1e8, which only the bias may show."""
    p = pairs(spark, d)
    fit = G.regress(p, F.col("c"), [F.col("a") + 1e8, F.col("b") * 64 + 1e8])
    return fit.select("series_id", "n", r(F.col("params")[0], 6).alias("p0"), r(F.col("params")[1], 6).alias("p1"), "rank_deficient")


OFFSET_REGRESSION = f"""with {PAIRS}, m as (select series_id, count(*) as n, regr_sxx(a, a) as aa, regr_sxx(x, x) as bb, regr_sxy(a, x) as ab, regr_sxy(a, c) as ac, regr_sxy(x, c) as bc
 from (select *, (b * 64 + 1e8::double) - 1e8::double as x from p) group by 1)
select series_id, n, round((ac * bb - bc * ab) / (aa * bb - ab * ab), 6) + 0.0 as p0, round((bc * aa - ac * ab) / (aa * bb - ab * ab), 6) + 0.0 as p1, false as rank_deficient from m"""


def gain_threshold(spark, d):
    """Where the gain of c over a changes; it is raised above a level that follows from the supplier."""
    p = pairs(spark, d)
    bend = F.greatest(F.col("a") - (15 + F.col("series_id") % 20), F.lit(0.0)) * (F.col("series_id") % 3 * 4 + 2)
    out = H.best_split(p, F.col("a"), F.col("c") + bend, block=8)
    return out.select("series_id", "threshold", "n_low", "n_high", r(F.col("gain_low"), 5).alias("gain_low"), r(F.col("gain_high"), 5).alias("gain_high"), r(F.col("sse"), 3).alias("sse"))


GAIN_THRESHOLD = f"""with {PAIRS}, z as (select series_id, a as u, c + greatest(a - (15 + series_id % 20), 0) * (series_id % 3 * 4 + 2) as y from p),
m as (select series_id, avg(u) as mu, avg(y) as my from z group by 1), g as (select series_id, u, count(*)::double as n, count(*) * (u - mu) as su, sum(y - my) as sy, count(*) * (u - mu) * (u - mu) as suu, (u - mu) * sum(y - my) as suy, sum((y - my) * (y - my)) as syy
  from z join m using (series_id) group by series_id, u, mu),
w as (select series_id, u, {", ".join(f"sum({c}) over w as l_{c}, sum({c}) over (partition by series_id) - sum({c}) over w as h_{c}" for c in ("n", "su", "sy", "suu", "suy", "syy"))} from g window w as (partition by series_id order by u rows unbounded preceding)),
v as (select *, {", ".join(f"{s}_suu - {s}_su * {s}_su / {s}_n as {s}_uu, {s}_suy - {s}_su * {s}_sy / {s}_n as {s}_uy, {s}_syy - {s}_sy * {s}_sy / {s}_n as {s}_yy" for s in "lh")} from w where l_n >= 3 and h_n >= 3),
e as (select *, l_uy / l_uu as gain_low, h_uy / h_uu as gain_high, l_yy - l_uy * l_uy / l_uu + h_yy - h_uy * h_uy / h_uu as sse from v where l_uu > 1e-9 * l_n and h_uu > 1e-9 * h_n)
select series_id, u::double as threshold, l_n::bigint as n_low, h_n::bigint as n_high, round(gain_low, 5) + 0.0 as gain_low, round(gain_high, 5) + 0.0 as gain_high, round(sse, 3) + 0.0 as sse from e
qualify row_number() over (partition by series_id order by round(sse, 6), u) = 1"""


def correlated(spark, d):
    p = pairs(spark, d)
    one = p.groupBy("series_id").agg(*[r(v, 5).alias(k) for k, v in G.simple_regression(F.col("c"), F.col("a")).items()])
    corr = G.correlations(p, "a", ["b", "c"])
    return corr.select("series_id", "signal", r(F.col("corr"), 5).alias("corr")).join(one, "series_id")


CORRELATED = f"""with {PAIRS}, g as (select series_id, corr(a, b) as b, corr(a, c) as c, regr_slope(c, a) as slope, regr_intercept(c, a) as intercept, regr_r2(c, a) as r2 from p group by 1)
select series_id, 'b' as signal, round(b, 5) as corr, round(slope, 5) as slope, round(intercept, 5) as intercept, round(r2, 5) as r2 from g
union all select series_id, 'c', round(c, 5), round(slope, 5), round(intercept, 5), round(r2, 5) from g"""


def gradients(spark, d):
    ev = events(spark, d)
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352.0
    return ev.groupBy("series_id").agg(r(G.gradient(F.col("x"), hours), 6).alias("gradient"))


GRADIENTS = f"with {EVENTS} select series_id, round(regr_slope(x, epoch_us(ts) / 3.6e9 - 473352.0), 6) as gradient from s group by 1"

QUERIES = {
    "win_moving_smooth_diff": (windows, WINDOWS), "filter_low_high_pass": (low_pass, LOW_PASS), "filter_low_pass_blocks": (low_pass_blocks, LOW_PASS_BLOCKS),
    "filter_low_pass_order_2": (low_pass_twice, LOW_PASS_TWICE),
    "filter_band_pass": (band_pass, BAND_PASS), "filter_second_order": (second_order, SECOND_ORDER), "recursive_average": (running_mean, RUNNING_MEAN),
    "fit_score": (fit_score, FIT_SCORE), "downsample_skipping_bad": (downsampled, DOWNSAMPLED), "asof_oversample": (oversampled, OVERSAMPLED),
    "index_at_date": (index_at, INDEX_AT), "signal_period": (period, PERIOD), "series_spectrum": (spectrum, SPECTRUM), "join_on_time": (time_join, TIME_JOIN), "dataset_combine": (combined, COMBINED),
    "dataset_concat_append": (concatenated, CONCATENATED), "dataset_wide_long": (wide_long, WIDE_LONG), "dataset_summary": (summarised, SUMMARISED),
    "quality_ignore_flags": (bad_data, BAD_DATA), "quality_frozen_oversampled": (frozen_runs, FROZEN_RUNS), "unit_oversampled_factor": (unit_factor, UNIT_FACTOR), "regress_two_inputs": (regression, REGRESSION),
    "regress_regularised": (ridge, RIDGE), "regress_at_an_offset": (offset_regression, OFFSET_REGRESSION), "correlate_signals": (correlated, CORRELATED), "gain_threshold": (gain_threshold, GAIN_THRESHOLD), "series_gradient": (gradients, GRADIENTS),
}
