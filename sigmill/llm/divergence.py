"""Divergence of sources from each other and from their language, by joint histograms of counts.

Every language keeps the terms that occur in enough of its documents.  A
group (lang, source), and the language itself, gives each kept term a
smoothed share p in units of 1 / UNIT, and f(p, q) = (p - q)^2 div q
measures how far p is from q.

Two sources are compared without running through their terms: f depends
on a term only by its two counts.  So for each pair of sources the
distinct (count, count) combinations are tallied, with the implied cells
in which one count or both are 0, f is evaluated once for a combination,
and multiplied with the number of terms that have it.

* Terms with the same counts in all sources are one signature: the corpus
  is reduced to signatures and their multiplicities before pairs of
  sources are formed, so rare terms, which are most, cost next to nothing.
* The cells with a 0 follow from each source's own histogram of counts by
  inclusion and exclusion; no row is made for a term that a source lacks.

Counts are gathered in one pass over the texts: a task counts terms by
group in Python and empties its counters when they are large, so hot
groups and hot terms are summed where they are read.  A signature has one
entry for each source of the language that has the term; as the result
itself has a row for every ordered pair of them, this is the smaller.

All arithmetic is exact: counts and shares are longs, products beyond them
decimals; a value that is no long raises an error instead of wrapping.

Defined cases: null text, lang or source counts as ''; repeated rows are
documents of their own; a group without terms has N = 0 and is compared
like any other; a language without kept terms has pairs of value 0 and no
terms; ties go to the item that is first in UTF-8; very long texts are
counted piece by piece; doc_id is not looked at, nor are other columns; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import forget, written

#: Parts of a whole in which shares are counted.
UNIT = 1_000_000_000
#: Documents of a language that must have a term; most terms reported for a group.
LEAST, MOST = 3, 200
#: Bytes of a text that are split at once, and entries of a task's counters before they are sent on.
PIECE, HELD = 1 << 20, 200_000

#: Letters A-Z become a-z, bytes of longer characters stay, all else divides terms.
_TERMS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
COUNTS = "lang string, source string, term binary, n bigint, docs bigint"


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of those of about PIECE bytes."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            while end < len(raw) and raw[end : end + 1].translate(_TERMS) != b" ":
                end += 1
        yield raw[at:end].translate(_TERMS).split()
        at = end


def _sent(total: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    for (lang, source), counts in total.items():
        found = [None, *counts]
        n, k = [0, *counts.values()], [0, *(docs[lang, source][t] for t in counts)]
        for a in range(0, len(found), 1 << 14):
            cut = slice(a, a + (1 << 14))
            size = len(found[cut])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), pa.array(found[cut], pa.binary()), pa.array(n[cut]), pa.array(k[cut])], schema=schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, offsets = K.buffers(batch.column(2))
        for i, group in enumerate(zip(langs, sources, strict=True)):
            mine = set()
            counts = total[group]
            for found in terms(data[offsets[i] : offsets[i + 1]].tobytes()):
                counts.update(found)
                mine.update(found)
            docs[group].update(mine)
        if sum(map(len, total.values())) > HELD:
            yield from _sent(total, docs)
            total, docs = defaultdict(Counter), defaultdict(Counter)
    yield from _sent(total, docs)


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS of every group: a term's occurrences and documents, and a row without a term."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")], "text")
    return named.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """p = 1 + floor(UNIT * (count + 1) / (total + v)), without rounding; all are columns of whole numbers."""
    return F.expr(f"(cast({UNIT} as decimal(10,0)) * (cast({count} as decimal(19,0)) + 1)) div (cast({total} as decimal(19,0)) + v) + 1")


def far(p: str, q: str) -> Column:
    """f of two columns of shares."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, total, cells: terms in at least so many documents of the language, and their counts in its sources."""
    return (
        counts.where("term is not null").groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
        .where(F.col("docs") >= least).drop("docs")
    )


def sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), lang_total (N of the language), v, of every group."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    own = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return out.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v")])


def histograms(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms by their counts: (lang, source, a, m) of each source, and (lang, s, t, a, b, m) of pairs s < t that share terms.

    a, b are counts over 0, m the number of terms.
    """
    signatures = kept.groupBy("lang", "cells").agg(F.count("*").alias("m"))
    single = signatures.select("lang", "m", F.inline("cells")).groupBy("lang", "source", F.col("n").alias("a")).agg(F.sum("m").alias("m"))
    first = signatures.where(F.size("cells") > 1).select("lang", "m", "cells", F.posexplode("cells").alias("i", "x"))
    second = first.select("lang", "m", "x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    both = second.groupBy("lang", F.col("x.source").alias("s"), F.col("y.source").alias("t"), F.col("x.n").alias("a"), F.col("y.n").alias("b"))
    return single, both.agg(F.sum("m").alias("m"))


def tallies(groups: DataFrame, single: DataFrame, joint: DataFrame) -> DataFrame:
    """lang, s, t, a, b, m: for all pairs s < t of a language's sources, how many of its terms have counts a and b, 0 included.

    A joint cell (a, b) takes its terms from what the two histograms give
    to (a, 0) and (0, b), and these take theirs from (0, 0), where all
    terms of the language begin.
    """
    pairs = groups.select("lang", F.col("source").alias("s"), "v").join(groups.select("lang", F.col("source").alias("t")), "lang").where("s < t")
    zero, m = F.lit(0).cast("bigint"), F.col("m")
    cell = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("m"))
    moved = lambda *cells: F.inline(F.array(*cells))
    start = pairs.select("lang", "s", "t", zero.alias("a"), zero.alias("b"), F.col("v").alias("m"))
    left = pairs.join(single.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", moved(cell(F.col("a"), zero, m), cell(zero, zero, -m)))
    right = pairs.join(single.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", moved(cell(zero, F.col("a"), m), cell(zero, zero, -m)))
    a, b = F.col("a"), F.col("b")
    shared = joint.select("lang", "s", "t", moved(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m)))
    rows = start.unionByName(left).unionByName(right).unionByName(shared)
    return rows.groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")


def between(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of a language's sources: f over its kept terms, by cells."""
    n = lambda c, out: groups.select("lang", F.col("source").alias(c), F.col("total").alias(out))
    v = groups.groupBy("lang").agg(F.max("v").alias("v"))
    shares = (
        cells.join(n("s", "ns"), ["lang", "s"]).join(n("t", "nt"), ["lang", "t"]).join(v, "lang")
        .select("lang", "s", "t", "m", share("a", "ns").alias("p"), share("b", "nt").alias("q"))
    )
    weigh = lambda p, q: F.sum(far(p, q).cast("decimal(19,0)") * F.col("m")).cast("bigint")
    found = shares.groupBy("lang", "s", "t").agg(weigh("p", "q").alias("st"), weigh("q", "p").alias("ts"))
    pairs = groups.select("lang", F.col("source").alias("s")).join(groups.select("lang", F.col("source").alias("t")), "lang").where("s < t")
    row = lambda *c: F.struct(*[F.col(x).alias(y) for x, y in zip(c, ("source", "item", "value"), strict=True)])
    both = pairs.join(found, ["lang", "s", "t"], "left").select("lang", F.inline(F.array(row("s", "t", "st"), row("t", "s", "ts"))))
    return both.withColumn("value", F.coalesce("value", F.lit(0)))


def over(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item, value of each group's terms with a greater share than in the language."""
    cells = kept.select("lang", "term", F.col("total").alias("all"), F.inline("cells"))
    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total").alias("p"), share("all", "lang_total").alias("q"))
    return shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), far("p", "q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has all other sources of the language, `term` up to `most` terms."""
    counts = written(counted(docs), "term-counts")
    kept = written(kept_terms(counts, least), "kept-terms")
    groups = written(sizes(counts.where("term is null").select("lang", "source"), kept), "term-groups")
    forget(counts)
    single, joint = (written(x, "count-histogram") for x in histograms(kept))
    pairs = between(groups, tallies(groups, single, joint))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    out = ranked(pairs, "pair").unionByName(ranked(over(groups, kept), "term").where(F.col("rank") <= most))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
w as (select row, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct row) >= 3),
l as (select lang, count(*) as v, sum(total) as lang_total from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
g as (select lang, source from d group by all),
grid as (select g.lang, g.source, term, total, coalesce(n, 0)::hugeint as n, sum(coalesce(n, 0)) over (partition by g.lang, g.source)::hugeint as own, v, lang_total::hugeint as lang_total
  from g join k using (lang) join l using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + 1000000000 * (n + 1) // (own + v) as p, 1 + 1000000000 * (total::hugeint + 1) // (lang_total + v) as q from grid),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 200
"""
