"""Mixing sources to target weights by weighted fair queueing (native).

Each source is a queue of its documents in a shuffled order that only
the doc_id decides.  A document that its source serves after `c` words
finishes at virtual time c / target; a source whose target exceeds its
size serves its queue again.  All sources' entries are range-sorted by
virtual finish time and the sorted table is cut at the total budget, so
every source has received its target when virtual time reaches 1.

Defined cases: null text has size 0; null source is one source, ranked
last; null doc_id is hashed as the text 'null'; repeated rows are served
one after another; an empty table gives an empty result; columns besides
doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, forget, ranges, running_total, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """First 32 bits of the id's MD5 as a long: an order any engine can repeat."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def row_tag() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def source_targets(sources: DataFrame, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) -> rank and target, one row per source.

    Weights repeat along the sources in code point order, null last.
    Water filling in one pass: sources in order of limit / weight reach
    their limit first; `level` is what a unit of weight gets when the
    first k are full, and the first k at which the next source stays
    within its limit is the answer.  The windows run over one row per
    source, never over documents.
    """
    ranked = sources.withColumn("srank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.col("srank") % len(WEIGHTS) + 1)
    limits = ranked.withColumn("w", w).withColumn("lim", (F.col("source_size") * passes).cast("double"))
    order = Window.orderBy(F.col("lim") / F.col("w"), "srank")
    full = F.coalesce(F.sum("lim").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    tried = limits.withColumn("level", (total * F.lit(share) - full) / rest).withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("lim") / F.col("w"), F.struct("k", "level"))
    chosen = F.min(fits).over(Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tried.withColumn("target", F.least(F.col("lim"), chosen["level"] * F.col("w"))).select(
        "source", "srank", "source_size", "target"
    )


def mix(docs: DataFrame, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """One row per document: doc_id, tag, source, size, source_size, target, taken.

    `taken` counts the words the mix takes from the document, repeats
    included; it never exceeds `passes` times its size.  The entry at
    which the budget ends may be taken in part.  Also returned: `served`,
    the passes that begin before the cut (a document of no words counts
    with its first pass), and `finish`, the virtual finish time of the
    first pass.
    """
    base = written(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("h"),
            row_tag().alias("tag"), F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, passes), "mix-targets")
    known = targets.agg(F.count("*"), F.sum("target")).first()
    rows = base.count()
    same = base["source"].eqNullSafe(targets["source"])
    # A bounded number of sources is broadcast; beyond it Spark joins on the key.
    side = F.broadcast(targets) if known[0] <= 100_000 else targets
    keyed = base.join(side, same).select("doc_id", "tag", "row", base["source"], "size", "h", "srank", "source_size", "target")
    order = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("row")]
    queued = running_total(keyed, ["srank"], "size", rows, "cum", order)
    times = [(F.col("cum") + F.col("size") + F.col("source_size") * p) / F.col("target") for p in range(passes)]
    queued = written(
        queued.select(
            "doc_id", "tag", "row", "source", "size", "source_size", "target", "srank",
            F.array(*[F.when(F.col("target") > 0, t) for t in times]).alias("finish"),
        ),
        "mix-times",
    )
    forget(base)
    merged = merge(queued, int(known[1] or 0), rows * passes)
    taken = merged.groupBy("row").agg(F.sum("got").alias("taken"), F.count("*").alias("served"))
    served = F.when(F.col("size") == 0, 1).otherwise(F.coalesce("served", F.lit(0)))
    return queued.join(taken, "row", "left").select(
        "doc_id", "tag", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), served.cast("int").alias("served"), F.col("finish")[0].alias("finish"),
    )


def merge(queued: DataFrame, budget: int, entries: int) -> DataFrame:
    """The mix in order: row, pass, finish, srank, size, got of each entry before the cut.

    Entries of all sources are range-sorted by virtual finish time.  The
    prefix sums of the ranges' totals tell which ranges are served whole
    and in which one the budget ends; running sums inside that range give
    the last entry's part.  Entries of no words take nothing and are left
    out.
    """
    each = queued.where("size > 0").select("row", "srank", "size", F.posexplode("finish").alias("pass", "finish")).where("finish is not null")
    order = ["finish", "srank", "pass", "row"]
    sort = ranges(each, [F.col(c) for c in order], entries, "mix-merged")
    totals = written(sort.groupBy("_range").agg(F.sum("size").alias("words")), "mix-ranges")
    # One row per range, of which there are at most MOST_RANGES.
    upto = F.sum("words").over(Window.orderBy("_range")) - F.col("words")
    begins = totals.withColumn("begin", upto).where(F.col("begin") < budget)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = begins.where(F.col("begin") + F.col("words") > budget)
    whole = sort.join(F.broadcast(begins.where(F.col("begin") + F.col("words") <= budget).select("_range")), "_range")
    last = sort.join(F.broadcast(ends.select("_range", (F.lit(budget) - F.col("begin")).alias("left"))), "_range")
    last = last.withColumn("got", F.least(F.col("size"), F.col("left") - F.sum("size").over(inside) + F.col("size"))).where("got > 0")
    columns = ["row", "pass", "finish", "srank", "size"]
    return whole.select(*columns, F.col("size").alias("got")).unionByName(last.select(*columns, "got"))


def mixed_stream(docs: DataFrame, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """The documents the mix serves, once per pass, all columns kept.

    Decisions are joined back by the row's tag; only wholly identical rows
    share one, and they are numbered.
    """
    order = Window.partitionBy("_mix_tag").orderBy("_mix_o")
    left = docs.withColumn("_mix_tag", row_tag()).withColumn("_mix_o", F.lit(0))
    left = left.withColumn("_mix_n", F.row_number().over(order)).drop("_mix_o")
    right = mix(docs, share, passes).select(
        F.col("tag").alias("_mix_tag"), F.col("served").alias("_mix_served"), F.col("finish").alias("_mix_o")
    )
    right = right.withColumn("_mix_n", F.row_number().over(order)).drop("_mix_o").where("_mix_served > 0")
    return (
        left.join(right, ["_mix_tag", "_mix_n"])
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_served"))))
        .select(*docs.columns)
    )


ORACLE = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as srank from s),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(srank % 3 + 1)::int] as w, (2 * source_size)::double as lim from r),
l as (select *, (1.5::double * (sum(source_size) over ())::double
         - coalesce(sum(lim) over (order by lim / w, srank rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by lim / w, srank rows between current row and unbounded following) as level,
         row_number() over (order by lim / w, srank) as k from w),
t as (select source, srank, source_size,
         least(lim, w * (select min_by(level, k) from l where level <= lim / w)) as target from l),
q as (select d.doc_id, d.size, t.source_size, t.target, t.srank,
         coalesce(sum(d.size) over (partition by t.srank order by d.h, d.doc_id nulls first, d.size
           rows between unbounded preceding and 1 preceding), 0) as cum
      from d join t on d.source is not distinct from t.source),
e as (select *, (cum + size + source_size * p)::double / target as f
      from q, (values (0), (1)) as passes(p) where target > 0),
m as (select *, sum(size) over (order by f, srank, p rows between unbounded preceding and current row) as upto,
         (select floor(sum(target))::bigint from t) as budget from e where size > 0),
g as (select doc_id, size, source_size, target, srank, cum,
         sum(greatest(0, least(size, budget - (upto - size))))::bigint as taken from m group by all)
select q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::bigint as taken
from q left join g on q.doc_id is not distinct from g.doc_id and q.srank = g.srank and q.cum = g.cum and q.size = g.size
"""


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
