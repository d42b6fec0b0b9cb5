"""Queries of element-wise functions, predicates, index algebra, reductions and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generators as G
from ..operators import ordered as N
from ..functions import predicates as P
from ..functions import reductions as R
from ..functions import scalar as S
from ..operators import dataset as D
from ..operators import series as O
from .base import EVENTS, PAIRS, events, pairs, r, table


def arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select(
        "l_orderkey", "l_linenumber", r(S.absolute(S.subtract(b, a))).alias("abs_diff"), r(S.add(a, b)).alias("added"),
        r(S.add(a, 1.5)).alias("plus"), r(S.subtract(a, 2.0, compat=True)).alias("minus"), r(S.multiply(a, b)).alias("product"),
        r(S.divide(a, b), 4).alias("quotient"), r(S.divide(b, 0)).alias("by_zero"), r(S.power(a, 1.5), 4).alias("powered"),
    )


ARITHMETIC = f"""with {PAIRS} select l_orderkey, l_linenumber, round(abs(b - a), 6) as abs_diff, round(a + b, 6) as added, round(a + 1.5, 6) as plus,
round(a - 2.0, 6) as minus, round(a * b, 6) as product, round(a / nullif(b, 0), 4) as quotient, cast(null as double) as by_zero,
round(pow(a, 1.5), 4) as powered from p"""


def clamps(spark, d):
    x = F.col("x")
    prev = F.lag("x").over(O.W())
    return events(spark, d).select(
        "series_id", "k", r(S.larger(x, prev)).alias("larger"), r(S.smaller(x, prev)).alias("smaller"), r(S.at_least(x, 30)).alias("low"),
        r(S.at_most(x, 60, compat=True)).alias("high"), r(S.replace_above(x, 80, 80.5)).alias("above"), r(S.replace_below(x, 5, 4.5)).alias("below"),
        r(S.replace_outside(x, 10, 90, -1)).alias("outside"),
    )


CLAMPS = f"""with {EVENTS}, q as (select *, lag(x) over (partition by series_id order by k) as p from s)
select series_id, k, round(case when x > p then x else p end, 6) as larger, round(case when x < p then x else p end, 6) as smaller,
round(case when x is not null then greatest(x, 30.0) end, 6) as low, round(coalesce(least(x, case when x is null then null else 60.0 end), 0), 6) as high,
round(case when x > 80 then 80.5 else x end, 6) as above, round(case when x < 5 then 4.5 else x end, 6) as below,
round(case when x < 10 or x > 90 then -1 else x end, 6) as outside from q"""


def digits(spark, d):
    x = F.col("x") * 1.4142135623730951
    parts = S.scientific(x, 4)
    return events(spark, d).where("x > 0").select(
        "series_id", "k", S.significant(x, 4).alias("four"), S.significant(x, 2).alias("two"), parts["exponent"].cast("long").alias("exponent"),
        S.parse_number(F.regexp_replace(F.format_string("%.3f", x), r"\.", ",")).alias("parsed"),
    )


DIGITS = f"""with {EVENTS}, q as (select series_id, k, x * 1.4142135623730951::double as x from s where x > 0)
select series_id, k, cast(printf('%.3e', x) as double) as four, cast(printf('%.1e', x) as double) as two,
cast(split_part(printf('%.3e', x), 'e', 2) as bigint) as exponent, cast(printf('%.3f', x) as double) as parsed from q"""


def pid_scaling(spark, d):
    x = F.col("x")
    points = [(0.0, 1.0), (25.0, 2.0), (60.0, 0.5), (100.0, 0.2)]
    return events(spark, d).select(
        "series_id", "k", r(S.scale_y(x, 0, 50)).alias("scaled"), r(x * S.kp_factor((0, 50), (0, 200), True)).alias("factored"),
        r(S.scheduled(x, points)).alias("kp"),
    )


PID_SCALING = f"""with {EVENTS} select series_id, k, round(x / 50.0, 6) as scaled, round(x * 0.25, 6) as factored,
round(case when x < 25 then (x - 0) * 0.04 + 1 when x > 60 then (x - 60) * ((0.2 - 0.5) / 40.0)::double + 0.5
  else (x - 25) * ((0.5 - 2.0)::double / 35.0) + 2 end, 6) as kp from {'s'}"""


def names(spark, d):
    id_ = F.col("user_id").cast("string")
    return table(spark, d, "events").select(
        "event_id", S.signal_name(F.concat(F.lit("m"), id_), F.lit("Output_Y")).alias("name"), S.signal_name(F.concat(F.lit("m"), id_), F.col("event_type"), F.col("event_id") % 3).alias("indexed"),
        S.disturbance_name(F.concat(F.lit("m"), id_)).alias("disturbance"), r(S.unix_seconds(F.col("ts")), 3).alias("unix"),
        (S.from_unix(S.unix_seconds(F.col("ts"))) == F.col("ts")).alias("back"),
    )


NAMES = """select event_id, 'm' || user_id || '-Output_Y' as name, 'm' || user_id || '-' || event_type || '-' || (event_id % 3) as indexed,
'_D_m' || user_id as disturbance, round(epoch_us(ts) / 1e6, 3) as unix, true as back from events"""

KINDS = ("BiggerThan", "SmallerThan", "BiggerOrEqual", "SmallerOrEqual", "Equal", "NotEqual", "NaN", "NotNaN", "SameAsPrevious", "DifferentFromPrevious", "Inf", "NotInf")


def find_values(spark, d):
    rows = events(spark, d).withColumn("x", F.round("x", 0))
    flags = rows.select("series_id", "k", *[P.found(F.col("x"), kind, 50.0, O.W()).alias(kind) for kind in KINDS])
    return flags.groupBy("series_id").agg(
        *[F.count_if(kind).alias("n_" + kind.lower()) for kind in KINDS], *[F.coalesce(F.sum(F.when(F.col(kind), F.col("k"))), F.lit(0)).alias("k_" + kind.lower()) for kind in KINDS]
    )


_SAME = "coalesce(x = p, false)"
_TESTS = dict(zip(KINDS, ("x > 50", "x < 50", "x >= 50", "x <= 50", "x = 50", "x <> 50", "x is null", "x is not null", _SAME, f"(not {_SAME} and k > 0)", "false", "true"), strict=True))
FIND_VALUES = f"""with {EVENTS}, q as (select series_id, k, round(x, 0) as x, lag(round(x, 0)) over (partition by series_id order by k) as p from s)
select series_id, {', '.join(f"count(*) filter (where {t}) as n_{k.lower()}, coalesce(sum(k) filter (where {t}), 0)::bigint as k_{k.lower()}" for k, t in _TESTS.items())}
from q group by series_id"""


def index_algebra(spark, d):
    rows = events(spark, d)
    flagged = rows.where("x > 70").select("series_id", "k")
    low = rows.where("x < 20 or k % 7 = 0").select("series_id", "k")
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    parts = {
        "inverse": D.inverse(flagged, sizes), "trailing": D.trailing(flagged), "shift": D.shift(flagged, -2), "union": D.union(flagged, low),
        "intersect": D.intersect(flagged, low), "remove": D.remove(low, flagged), "values_at": D.values_at(rows, flagged).select("series_id", "k"),
        "excluding": D.values_excluding(rows, flagged).select("series_id", "k"), "subset": O.subset(rows, 2, 9).select("series_id", "k"),
        "percent": O.subset_percent(rows, 20, 55).select("series_id", "k"), "downsample": O.downsample(rows, 4, 1).select("series_id", "k"),
    }
    out = None
    for name, part in parts.items():
        one = part.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k")).withColumn("what", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


INDEX_ALGEBRA = f"""with {EVENTS}, f as (select series_id, k from s where x > 70), l as (select series_id, k from s where x < 20 or k % 7 = 0),
c as (select series_id, count(*) as n from s group by 1), u as (
select 'inverse' as what, series_id, k from (select series_id, k from s except select * from f)
union all select 'trailing', * from (select * from f union select series_id, k + 1 from f)
union all select 'shift', series_id, k - 2 from f where k >= 2
union all select 'union', * from (select * from f union select * from l)
union all select 'intersect', * from (select * from f intersect select * from l)
union all select 'remove', * from (select * from l except select * from f)
union all select 'values_at', * from f
union all select 'excluding', * from (select series_id, k from s except select * from f)
union all select 'subset', series_id, k from s where k between 2 and 9
union all select 'percent', s.series_id, k from s join c using (series_id) where k between floor(n * 0.2) and floor(n * 0.55::double)
union all select 'downsample', series_id, k from s where k >= 1 and (k - 1) % 4 = 0)
select what, series_id, count(*) as n, sum(k)::bigint as sum_k from u group by all"""


def vector_checks(spark, d):
    x = F.col("x")
    return events(spark, d).withColumn("y", F.lag("x", 0).over(O.W())).groupBy("series_id").agg(
        P.contains_bad(x).alias("has_bad"), P.all_missing(x).alias("all_missing"), P.all_value(x, 0).alias("all_zero"),
        P.constant(F.floor(x / 1000)).alias("constant"), P.all_equal(x, F.col("y")).alias("equal"),
    )


VECTOR_CHECKS = f"""with {EVENTS} select series_id, bool_or(x is null) as has_bad, bool_and(x is null) as all_missing, bool_and(coalesce(x = 0, false)) as all_zero,
(count(distinct floor(x / 1000)) + (count(*) > count(x))::int) <= 1 as constant, bool_and(x is not null) as equal from s group by series_id"""


def reductions(spark, d):
    x, k = F.col("x"), F.col("k")
    return events(spark, d).groupBy("series_id").agg(
        r(R.mean(x)).alias("mean"), r(R.total(x), 4).alias("total"), r(R.largest(x)).alias("largest"), R.first_largest(x, k).alias("k_largest"),
        r(R.smallest(x)).alias("smallest"), R.first_smallest(x, k).alias("k_smallest"), r(R.span(x)).alias("span"), r(R.variation(x), 3).alias("variation"),
        r(R.variation(x, True), 4).alias("variance"), r(R.square_error(x, 50.0)).alias("around_50"), r(R.time_base(S.unix_seconds(F.col("ts"))), 3).alias("time_base"),
        F.count(F.lit(1)).alias("n"),
    )


REDUCTIONS = f"""with {EVENTS} select series_id, round(coalesce(avg(x), 0), 6) as mean, round(coalesce(sum(x), 0), 4) as total, round(max(x), 6) as largest,
coalesce(arg_min(k, (-x, k)) filter (where x is not null), 0) as k_largest, round(min(x), 6) as smallest, coalesce(arg_min(k, (x, k)) filter (where x is not null), 0) as k_smallest,
round(max(x) - min(x), 6) as span, round(var_pop(x) * count(x), 3) as variation, round(var_pop(x), 4) as variance, round(avg((x - 50) * (x - 50)), 6) as around_50,
round(case when count(*) <= 2 then 0 else (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / (count(*) - 1) end, 3) as time_base, count(*) as n from s group by series_id"""


def pair_errors(spark, d):
    a, c = F.col("a"), F.col("c")
    return pairs(spark, d).groupBy("series_id").agg(
        r(R.covariation(a, c), 2).alias("covariation"), r(R.covariation(a, c, True)).alias("normed"), r(R.mean_abs_error(a, c)).alias("mae"),
        r(R.square_error(a, c)).alias("mse"), r(R.square_error(a, c, False), 2).alias("sse"), r(R.r_squared(a, c)).alias("r_squared"),
    )


PAIR_ERRORS = f"""with {PAIRS} select series_id, round(covar_pop(a, c) * count(*), 2) as covariation, round(covar_pop(a, c) / (max(abs(a)) * max(abs(c))), 6) as normed,
round(avg(abs(c - a)), 6) as mae, round(avg((c - a) * (c - a)), 6) as mse, round(sum((c - a) * (c - a)), 2) as sse,
round(1 - avg((c - a) * (c - a)) / (var_pop(a) + (avg(a) - avg(c)) * (avg(a) - avg(c))), 6) as r_squared from p group by series_id"""


def matrices(spark, d):
    rows = events(spark, d).withColumn("p", F.coalesce(F.lag("x").over(O.W()), F.lit(0.0))).where("x is not null")
    m = D.matrix(rows, ["x", "p"])
    changed = D.replace_column(D.times_scalar(m, 2.0, 1), 0, F.lit(1.0))
    return D.times_vector(m, [0.5, -1.0]).select("series_id", "k", r(F.col("y")).alias("y")).join(
        D.times_vector(D.get_columns(changed, [1, 0]), [1.0, 3.0]).select("series_id", "k", r(F.col("y")).alias("z")), ["series_id", "k"]
    )


MATRICES = f"""with {EVENTS}, q as (select series_id, k, x, coalesce(lag(x) over (partition by series_id order by k), 0) as p from s)
select series_id, k, round(x * 0.5 - p, 6) + 0.0 as y, round(2 * p + 3, 6) as z from q where x is not null"""


def transposing(spark, d):
    m = D.matrix(events(spark, d).where("x is not null").withColumn("y", F.col("x") * 2), ["x", "y"])
    return D.transposed(m).select("series_id", F.col("i").cast("long").alias("i"), F.size("column").cast("long").alias("n"), r(F.col("column")[0]).alias("first"), r(F.element_at("column", -1)).alias("last"))


TRANSPOSING = f"""with {EVENTS}, q as (select * from s where x is not null), i as (select series_id, 0::bigint as i, k, x as v from q union all select series_id, 1, k, 2 * x from q)
select series_id, i, count(*) as n, round(arg_min(v, k), 6) as first, round(arg_max(v, k), 6) as last from i group by series_id, i"""


def sorting(spark, d):
    return D.sorted_values(events(spark, d), False).select("series_id", "place", "k", r(F.col("x")).alias("x"))


SORTING = f"""with {EVENTS} select series_id, row_number() over (partition by series_id order by x desc nulls last, k) - 1 as place, k, round(x, 6) as x from s"""


def generated(spark, d):
    """Generated signals at the positions of each user's events."""
    k = F.col("k")
    return events(spark, d).select(
        "series_id", "k", G.time_at(k, 0.5).alias("ts"), G.step(k, 20, 0, 1).alias("step"), G.two_steps(k, 20, 40, 0, 1, 3).alias("two"),
        G.three_steps(k, 20, 40, 55, 0, 1, 3, 2).alias("three"), r(G.ramp(k, 31, 1, 5, 10)).alias("ramp"), r(G.sinus(k, 5, 20, 0.5)).alias("sinus"),
    )


GENERATED = f"""with {EVENTS} select series_id, k, timestamp '2010-01-01' + to_microseconds(k * 500000) as ts, case when k <= 20 then 0.0::double else 1 end as step,
case when k <= 20 then 0.0::double when k < 40 then 1 else 3 end as two, case when k <= 20 then 0.0::double when k < 40 then 1 when k < 55 then 3 else 2 end as three,
round(1 + least(greatest((k - 10) / 30.0::double, 0), 1) * 4, 6) as ramp, round(5 * sin(k * (2 * pi() * 0.5 / 20)), 6) + 0.0 as sinus from s"""


def noises(spark, d):
    """Noise and a random walk at the positions of each user's events."""
    k = F.col("k")
    ev = events(spark, d).withColumns({"noise": G.noise(k, 2.0, 7), "by": G.walk_step(k, 0.5, 10, 3)})
    return N.running_sum(ev, F.col("by"), "walk", 24).select("series_id", "k", r(F.col("noise"), 9).alias("noise"), r(F.col("walk"), 9).alias("walk"))


_UNIFORM = "(('0x' || substr(md5(k || ':{seed}'), 1, 13))::bigint::double / 2251799813685248 - 1)"
NOISES = f"""with {EVENTS}, u as (select series_id, k, {_UNIFORM.format(seed=7)} as a, {_UNIFORM.format(seed=3)} as b from s)
select series_id, k, round(2 * a, 9) + 0.0 as noise, round(sum(case when k > 0 then b / 2 else 10 end) over (partition by series_id order by k), 9) + 0.0 as walk from u"""


def array_texts(spark, d):
    rows = events(spark, d).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    return rows.select("series_id", S.array_text(F.col("v"), 4).alias("text"))


# Decimals round half up, as Spark does; values are 0 to 10000 with two digits.
ARRAY_TEXTS = f"""with {EVENTS}, q as (select series_id, k, x::decimal(18, 4) as x from s),
v as (select series_id, k, case when x >= 1000 then round(x, 0)::double when x >= 100 then round(x, 1)::double else x::double end as x from q)
select series_id, '[' || string_agg(coalesce(x::varchar, 'NaN'), ';' order by k) || ']' as text from v group by 1"""


QUERIES = {
    "vec_arithmetic": (arithmetic, ARITHMETIC), "vec_clamps": (clamps, CLAMPS), "vec_significant_digits": (digits, DIGITS),
    "pid_scaling_schedule": (pid_scaling, PID_SCALING), "signal_names_unix_time": (names, NAMES), "vec_find_values": (find_values, FIND_VALUES),
    "index_algebra": (index_algebra, INDEX_ALGEBRA), "vec_checks": (vector_checks, VECTOR_CHECKS), "vec_reductions": (reductions, REDUCTIONS),
    "vec_pair_errors": (pair_errors, PAIR_ERRORS), "matrix_products": (matrices, MATRICES), "matrix_transpose": (transposing, TRANSPOSING),
    "vec_sort": (sorting, SORTING), "generators": (generated, GENERATED), "noise_generators": (noises, NOISES), "vec_to_string": (array_texts, ARRAY_TEXTS),
}
