"""Queries of models, simulation, identification and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import control as K
from ..operators import dataset as D
from ..operators import lagged as L
from ..operators import ordered as N
from ..operators import recursive as C
from ..operators import series as O
from ..operators import units as U
from ..plans import identify as I
from ..plans import models as M
from ..plans import plant as P
from ..sources import files
from ..sources.plants import plant_to_json
from ..streaming import dataset as A
from ..streaming import stateful as T
from .base import BAD_EVERY, EVENTS, events, r, table


def static_models(spark, d):
    x = F.col("x")
    y = S.steady_state([x, F.col("k").cast("double")], 5.0, [1.5, -0.25], [10.0, 0.0], [0.02, 0.0])
    prev = F.lag("x").over(O.W())
    return events(spark, d).select(
        "series_id", "k", r(y).alias("y"), r(S.steady_input(x, 5.0, 1.5, 2.0)).alias("u_linear"), r(S.steady_input(x, 5.0, 1.5, 2.0, -0.01)).alias("u_curved"),
        r(S.integrated_gain(20.0, x, [30.0, 60.0], [1.0, 2.0, 0.5])).alias("integral"), r(S.select([x, prev], "MIN")).alias("least"),
        r(S.select([x, prev], "MAX")).alias("most"), r(S.divide_model(x, prev, 2.0, 0.1, 50), 9).alias("divided"),
    )


_SQ = "2.25::double - 0.04 * (x - 5)"
STATIC_MODELS = f"""with {EVENTS}, q as (select *, lag(x) over (partition by series_id order by k) as p from s)
select series_id, k, round(5 + 1.5 * (x - 10) + 0.02 * (x - 10) * (x - 10) - 0.25 * k, 6) + 0.0 as y, round((x - 5) / 1.5 + 2, 6) + 0.0 as u_linear,
round(case when x is null then null when {_SQ} > 0 then least((-1.5 + sqrt(greatest({_SQ}, 0))) / -0.02::double, (-1.5 - sqrt(greatest({_SQ}, 0))) / -0.02::double) else 75 end + 2, 6) + 0.0 as u_curved,
round((least(x, 30) - 20) * 1.0 + (least(greatest(x, 30), 60) - 30) * 2.0 + (greatest(x, 60) - 60) * 0.5 + (case when x is null then null else 0 end), 6) + 0.0 as integral,
round(least(x, p), 6) as least, round(greatest(x, p), 6) as most,
round(case when x / nullif(p, 0) is null then -9999 else greatest(least(x / p * 2, 50), 0.1) end, 9) as divided from q"""


def unit_step(spark, d):
    """A first-order process with a delay of two samples, driven by each series."""
    out = U.response(events(spark, d), ["x"], [0.8], 2.0, [10.0], time_constant_s=4.0, delay_s=2.0, block=16)
    return out.select("series_id", "k", r(F.col("y")).alias("y"))


_FILLED = """f as (select series_id, k, coalesce(last_value(x ignore nulls) over (partition by series_id order by k rows between unbounded preceding and current row),
  first_value(x ignore nulls) over (partition by series_id order by k rows between current row and unbounded following)) as x from s)"""
UNIT_STEP = f"""with recursive {EVENTS}, {_FILLED}, t as (select series_id, k, 2 + 0.8 * (x - 10) as x from f),
g as (select 0::bigint as k, series_id, x as y from t where k = 0
 union all select t.k, t.series_id, g.y * 0.8::double + t.x * (1 - 0.8::double) from g join t on t.series_id = g.series_id and t.k = g.k + 1)
select series_id, k, round(case when k < 2 then y else lag(y, 2) over (partition by series_id order by k) end, 6) as y from g"""


def pid_step(spark, d):
    """A PI controller on each series with a fixed set point."""
    out = K.pid(events(spark, d), F.col("x"), F.lit(50.0), 0.3, 25.0, block=16)
    return out.select("series_id", "k", r(F.col("u")).alias("u"))


PID_STEP = f"""with recursive {EVENTS}, g as (select -1::bigint as k, series_id, 0.0::double as u, 0.0::double as e from s where k = 0
 union all select s.k, s.series_id, case when x is null then g.u else least(100, greatest(0, g.u + 0.3 * ((50 - x) - g.e) + 0.3 / 25::double * (50 - x))) end,
 case when x is null then g.e else 50 - x end from g join s on s.series_id = g.series_id and s.k = g.k + 1)
select series_id, k, round(u, 6) as u from g where k >= 0"""


def loop_plant() -> P.Plant:
    process = M.UnitModel("Process", M.UnitParameters([1.0], 5.0, 10.0, 5.0), ["Pid-U"], "Process-Y", ["D"])
    pid = M.PidModel("Pid", M.PidParameters(0.5, 20.0), ["Process-Y", "Yset"], "Pid-U")
    return P.Plant([pid, process], "loop")


def serial_plant() -> P.Plant:
    first = M.UnitModel("First", M.UnitParameters([1.0, 0.5], 5.0, 10.0, 5.0), ["Yset", "D"], "First-Y")
    second = M.UnitModel("Second", M.UnitParameters([1.1], 5.0, 20.0, 10.0, curvatures=[0.01], u0=[50.0]), ["First-Y"], "Second-Y")
    most = M.SelectModel("Most", "MAX", ["First-Y", "Second-Y"], "Most-Y")
    return P.Plant([first, second, most], "serial")


def scenario_inputs(spark, d, plants, n=200):
    """A scenario for each customer segment's share: set point steps and disturbances by id."""
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scenario_id"))
    k, s = F.col("k"), F.col("scenario_id")
    return ids.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select(
        F.explode(F.array(*map(F.lit, plants))).alias("plant_id"), "scenario_id", "k",
        F.when(k < 50, 50.0).otherwise(50.0 + s / 5.0).alias("Yset"), F.when(k < 120, 0.0).otherwise((s % 7 - 3).cast("double")).alias("D"),
    )


def simulated(spark, d):
    plants = {"loop": plant_to_json(loop_plant()), "serial": plant_to_json(serial_plant())}
    out = P.simulate(scenario_inputs(spark, d, list(plants)), plants, 1.0)
    return out.select("plant_id", "scenario_id", "k", "signal", r(F.col("value"), 5).alias("value"))


def _loops(spark, d):
    plants = {"loop": plant_to_json(loop_plant())}
    sim = P.simulate(scenario_inputs(spark, d, list(plants)), plants, 1.0)
    wide = sim.groupBy("scenario_id", "k").pivot("signal", ["Pid-U", "Process-Y"]).agg(F.first("value"))
    given = scenario_inputs(spark, d, list(plants)).select("scenario_id", "k", "Yset", "D")
    rows = wide.join(given, ["scenario_id", "k"]).where("scenario_id > 0")
    return rows.select(F.col("scenario_id").alias("series_id"), "k", F.col("Pid-U").alias("u"), F.col("Process-Y").alias("y"), "Yset", F.col("D").alias("given"))


def _found(df):
    return df.select("series_id", "kind", "able", r(F.col("fit_score"), 3).alias("fit_score"), "params")


def _numbers(df, **paths):
    """Whether a fit was able and scores over 99 %, and numbers of its parameters."""
    number = lambda path: r(F.get_json_object("params", f"$.{path}").cast("double"), 1)
    return df.select("series_id", "able", (F.col("fit_score") > 99).alias("fits"), *[number(v).alias(k) for k, v in paths.items()])


def _joined(rows, more):
    return rows.join(more, ["series_id", "k"])


def identified_units(spark, d):
    rows = scenario_inputs(spark, d, ["serial"]).where("scenario_id > 0").select(F.col("scenario_id").alias("series_id"), "k", F.col("Yset").alias("u"), "D")
    y = U.response(rows, ["u", "D"], [1.5, 0.7], 5.0, [50.0, 0.0], time_constant_s=6.0, delay_s=3.0)
    found = I.per_series(_joined(rows, y), lambda p: I.identify_unit(p["y"], p[["u", "D"]].to_numpy(float), 1.0)[0], ["u", "D", "y"])
    return _numbers(found, gain_u="gains[0]", gain_d="gains[1]", time_constant_s="time_constant_s", delay_s="delay_s")


#: The true parameters; an input that never moves has no gain.
IDENT_UNIT = """select n_nationkey as series_id, true as able, true as fits, 1.5::double as gain_u, case when n_nationkey % 7 = 3 then 0 else 0.7::double end as gain_d, 6::double as time_constant_s,
3::double as delay_s from nation where n_nationkey > 0"""


def identified_pids(spark, d):
    found = I.per_series(_loops(spark, d), lambda p: I.identify_pid(p["y"], p["Yset"], p["u"], 1.0)[0], ["u", "y", "Yset"])
    return _numbers(found, kp="kp", ti_s="ti_s")


IDENT_PID = "select n_nationkey as series_id, true as able, true as fits, 0.5::double as kp, 20::double as ti_s from nation where n_nationkey > 0"


def identified_loops(spark, d):
    pid = M.PidParameters(0.5, 20.0)
    return _found(I.per_series(_loops(spark, d), lambda p: I.identify_closed_loop(p["y"], p["Yset"], p["u"], 1.0, pid)[0], ["u", "y", "Yset"]))


def identified_schedules(spark, d):
    rows = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("series_id")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(319).cast("long"))))

    s = F.col("series_id")
    rows = rows.withColumn("u", F.floor(F.col("k") / 20).cast("double"))
    level = 10.0 + F.when(F.col("u") <= 7, F.col("u") - 5).otherwise(2.0 + (F.col("u") - 7) * (2 + s))
    y = C.low_pass(rows.select("series_id", "k", level.alias("x")), 3.0).select("series_id", "k", "y")
    found = I.per_series(_joined(rows, y), lambda p: I.identify_gain_sched(p["y"], p["u"], 1.0, coarse=20, fine=10)[0], ["u", "y"])
    return _numbers(found, threshold="thresholds[0]", low="gains[0][0]", high="gains[1][0]", time_constant_s="time_constants_s[0]")


IDENT_GAIN_SCHED = "select r_regionkey as series_id, true as able, true as fits, 7::double as threshold, 1::double as low, 2.0::double + r_regionkey as high, 3::double as time_constant_s from region"


def disturbances(spark, d):
    """The disturbance of each loop, from the known process; the last value is the true one."""
    loops = _loops(spark, d)
    found = U.disturbance(loops, "y", ["u"], [1.0], bias=5.0, time_constant_s=10.0, delay_s=5.0, block=64)
    out = found.join(loops.select("series_id", "k", "given"), ["series_id", "k"])
    return out.groupBy("series_id").agg(r(F.max_by("d", "k"), 3).alias("last"), r(F.max_by("given", "k"), 3).alias("true"))


DISTURBANCES = """select n_nationkey as series_id, (n_nationkey % 7 - 3)::double as last, (n_nationkey % 7 - 3)::double as true from nation where n_nationkey > 0"""


def shifted_correlations(spark, d):
    ev = events(spark, d).withColumn("x", F.coalesce("x", F.lit(50.0)))
    low = N.haloed(C.low_pass(ev, 4.0), 2)
    late = N.own(low.withColumn("late", F.when(F.col("k") < 2, F.col("y")).otherwise(F.lag("y", 2).over(N.B()))))
    out = L.strongest_shifts(late, "late", ["x", "y"], 8, block=32)
    return out.select("series_id", "signal", r(F.col("corr"), 4).alias("corr"), r(F.col("time_constant_s"), 3).alias("time_constant_s"), "delay_s")


def _lag_fits(signals: list[str], y: str, lags: int) -> str:
    """CTEs `fit` (series_id, signal, lag, n, a, b, rsq) and `best`, by joins of samples with those so many before; from `z` (series_id, k, signals)."""
    pair = " union all ".join(f"select '{x}' as signal, g.lag, c.series_id, c.{y} as y, p.{y} as y1, o.{x} as x from z c join z p on p.series_id = c.series_id and p.k = c.k - 1, range({lags + 1}) as g(lag), z o where o.series_id = c.series_id and o.k = c.k - g.lag" for x in signals)
    return f"""j as ({pair}), m as (select series_id, signal, lag, count(*) as n, var_pop(y) as yy, covar_pop(y, y1) as yp, covar_pop(y, x) as yx, var_pop(y1) as pp, covar_pop(y1, x) as px, var_pop(x) as xx
  from j where y is not null and y1 is not null and x is not null group by all),
e as (select *, pp * xx - px * px as det from m), f as (select *, (yp * xx - yx * px) / det as a, (yx * pp - yp * px) / det as b from e where det > 1e-9 * pp * xx),
fit as (select *, round((a * yp + b * yx) / yy, 9) as rsq, b / nullif(1 - a, 0) as gain, case when a >= 0 and a < 1 then a / (1 - a) else 0 end as tc from f where yy > 0),
best as (select * from fit qualify row_number() over (partition by series_id, signal order by rsq desc, lag) = 1)"""


SHIFTED = f"""with recursive {EVENTS}, f0 as (select series_id, k, coalesce(x, 50) as x from s), g0 as (select 0::bigint as k, series_id, x as y from f0 where k = 0
 union all select f0.k, f0.series_id, g0.y * (1 / (1 + 1 / 4.0::double)) + f0.x * (1 - 1 / (1 + 1 / 4.0::double)) from g0 join f0 on f0.series_id = g0.series_id and f0.k = g0.k + 1),
z as (select g0.series_id, g0.k, f0.x, g0.y, case when g0.k < 2 then g0.y else lag(g0.y, 2) over (partition by g0.series_id order by g0.k) end as late from g0 join f0 using (series_id, k)), {_lag_fits(["x", "y"], "late", 8)},
c as (select series_id, 'x' as signal, corr(late, x) as corr from z group by 1 union all select series_id, 'y', corr(late, y) from z group by 1)
select series_id, signal, round(corr, 4) + 0.0 as corr, round(case when abs(corr) >= 0.4 and rsq >= 0.1 then tc end, 3) as time_constant_s, case when abs(corr) >= 0.4 and rsq >= 0.1 then lag end::double as delay_s
from c left join best using (series_id, signal) where corr is not null and not isnan(corr)"""


def delay_search(spark, d):
    """Each series, low-passed and late by a number of samples that follows from its id, against itself."""
    ev = events(spark, d).withColumn("x", F.coalesce("x", F.lit(50.0)))
    low = N.haloed(C.low_pass(ev, 1.5), 5)
    late = F.coalesce(*[F.when(F.col("series_id") % 6 == i, F.lag("y", i).over(N.B()) if i else F.col("y")) for i in range(6)])
    out = L.delays(N.own(low.withColumn("late", late)), "late", ["x"], 7, block=32)
    return out.select("series_id", "n", "delay_s", r(F.col("time_constant_s"), 4).alias("time_constant_s"), r(F.col("gain"), 4).alias("gain"), r(F.col("rsq"), 4).alias("rsq"))


DELAY_SEARCH = f"""with recursive {EVENTS}, f0 as (select series_id, k, coalesce(x, 50) as x from s), g0 as (select 0::bigint as k, series_id, x as y from f0 where k = 0
 union all select f0.k, f0.series_id, g0.y * 0.6::double + f0.x * (1 - 0.6::double) from g0 join f0 on f0.series_id = g0.series_id and f0.k = g0.k + 1),
z as (select g0.series_id, g0.k, f0.x, lag(g0.y, (g0.series_id % 6)::int) over (partition by g0.series_id order by g0.k) as late from g0 join f0 using (series_id, k)), {_lag_fits(["x"], "late", 7)}
select series_id, n, lag::double as delay_s, round(tc, 4) + 0.0 as time_constant_s, round(gain, 4) + 0.0 as gain, round(rsq, 4) + 0.0 as rsq from best"""


def graph_closure(spark, d):
    """Everything downstream of each node, where customers and suppliers lead to their nation and nations to their region."""
    edge = lambda t, a, ka, b, kb: table(spark, d, t).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("a"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("b"))
    return D.reachable(edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey")))


GRAPH = """with recursive e as (select 'c' || c_custkey as a, 'n' || c_nationkey as b from customer union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
t as (select a, b from e union select t.a, e.b from t join e on e.a = t.b) select a, b from t"""


def steady_sweep(spark, d):
    """Steady state output over the whole numbers that events reach: the data of a gain plot."""
    g = M.GainSchedParameters([[1.0], [2.0], [0.5]], [30.0, 60.0], operating_u=20.0, operating_y=5.0)
    y = S.integrated_gain(g.operating_u, F.col("u"), g.thresholds, [v[0] for v in g.gains]) + g.operating_y
    levels = events(spark, d).where("x is not null").groupBy(F.floor("x").cast("double").alias("u")).agg(F.count("*").alias("n"))
    return levels.select("u", "n", r(y).alias("y"))


STEADY_SWEEP = f"""with {EVENTS}, l as (select floor(x) as u, count(*) as n from s where x is not null group by 1)
select u, n, round(5 + (least(u, 30) - 20) * 1.0::double + (least(greatest(u, 30), 60) - 30) * 2.0 + (greatest(u, 60) - 60) * 0.5, 6) as y from l"""


def csv_text(spark, d):
    """Signals written as CSV lines and read back, to five digits."""
    ev = events(spark, d)
    lines = files.csv_lines(ev.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), ["x"]).where("k >= 0")
    cell = F.split("line", ";")
    return lines.select("series_id", "k", F.try_to_timestamp(cell[0]).cast("timestamp_ntz").alias("ts"), r(F.nanvl(cell[1].try_cast("double"), F.lit(-9999.0)), 2).alias("x"))


CSV_TEXT = f"with {EVENTS} select series_id, k, date_trunc('second', ts) as ts, round(coalesce(x, -9999), 2) as x from s"


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    # A pattern, since the table may be one file or a folder of files.
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    x = F.when(F.col("event_id") % BAD_EVERY == 0, None).otherwise(F.col("value"))
    return raw.select(F.col("user_id").alias("series_id"), "ts", x.alias("x"))


def stream_mean(spark, d):
    out = T.drained(T.running_mean(_stream(spark, d)))
    return out.select("series_id", "ts", r(F.col("y"), 9).alias("y"))


STREAM_MEAN = f"with {EVENTS} select series_id, ts, round(coalesce(avg(x) over (partition by series_id order by k rows between unbounded preceding and current row), 0), 9) as y from s"


def stream_low_pass(spark, d):
    out = T.drained(T.low_pass(_stream(spark, d).where("x is not null"), 5.0))
    return out.select("series_id", "ts", r(F.col("y")).alias("y"))


STREAM_LOW_PASS = f"""with recursive {EVENTS}, f as (select series_id, ts, x, row_number() over (partition by series_id order by ts) - 1 as k from s where x is not null),
g as (select 0::bigint as k, series_id, ts, x as y from f where k = 0
 union all select f.k, f.series_id, f.ts, g.y * (1 / (1 + 1 / 5.0::double)) + f.x * (1 - 1 / (1 + 1 / 5.0::double)) from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select series_id, ts, round(y, 6) as y from g"""


def stream_append(spark, d):
    """Events as points of a signal for each type; rows within ten minutes of the end are not complete."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    points = raw.select(F.col("user_id").alias("series_id"), "ts", F.col("event_type").alias("signal"), F.col("value").alias("x"))
    return T.drained(A.appended(points)).select("series_id", "k", "ts", "signal", r(F.col("x")).alias("x"))


STREAM_APPEND = """with e as (select user_id as series_id, ts::timestamp as ts, event_type as signal, any_value(value) as x from events where event_type is not null and ts is not null group by all),
c as (select * from e where ts <= (select max(ts)::timestamp - interval 10 minute from events)),
t as (select series_id, ts, row_number() over (partition by series_id order by ts) - 1 as k from c group by series_id, ts), s as (select distinct series_id, signal from c)
select t.series_id, t.k, t.ts, s.signal, round(c.x, 6) as x from t join s on s.series_id = t.series_id left join c on c.series_id = t.series_id and c.ts = t.ts and c.signal = s.signal"""


def stream_pid(spark, d):
    out = T.drained(T.pid(_stream(spark, d).where("x is not null"), M.PidParameters(0.3, 25.0), 50.0))
    return out.groupBy("series_id").agg(F.count("*").alias("n"), r(F.max_by("y", "ts"), 5).alias("u_last"))


STREAM_PID = f"""with recursive {EVENTS}, f as (select series_id, x, row_number() over (partition by series_id order by ts) - 1 as k from s where x is not null),
g as (select -1::bigint as k, series_id, 0.0::double as u, 0.0::double as e from f where k = 0
 union all select f.k, f.series_id, least(100, greatest(0, g.u + 0.3 * ((50 - x) - g.e) + 0.3 / 25::double * (50 - x))), 50 - x from g join f on f.series_id = g.series_id and f.k = g.k + 1)
select series_id, max(k) + 1 as n, round(max_by(u, k), 5) + 0.0 as u_last from g where k >= 0 group by 1"""


QUERIES = {
    "model_static": (static_models, STATIC_MODELS), "model_unit_dynamic": (unit_step, UNIT_STEP), "pid_controller": (pid_step, PID_STEP),
    "plant_simulate": (simulated, None), "ident_unit": (identified_units, IDENT_UNIT), "ident_pid": (identified_pids, IDENT_PID),
    "ident_closed_loop": (identified_loops, None), "ident_gain_sched": (identified_schedules, IDENT_GAIN_SCHED), "disturbance_estimate": (disturbances, DISTURBANCES),
    "correlate_and_shift": (shifted_correlations, SHIFTED), "delay_search": (delay_search, DELAY_SEARCH), "plant_graph_closure": (graph_closure, GRAPH), "gain_sweep": (steady_sweep, STEADY_SWEEP),
    "csv_roundtrip": (csv_text, CSV_TEXT), "stream_running_mean": (stream_mean, STREAM_MEAN), "stream_low_pass": (stream_low_pass, STREAM_LOW_PASS),
    "stream_append_points": (stream_append, STREAM_APPEND), "stream_pid": (stream_pid, STREAM_PID),
}
