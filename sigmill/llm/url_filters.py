"""URL filters: rules, then trust and distrust over the host graph.

Hosts of pages that an allow rule fits are trusted seeds and hosts of
pages that a block rule fits are distrusted ones, in proportion to those
pages.  Trust is a personalised PageRank along the links between hosts,
distrust one along the reversed links; a host whose distrust exceeds its
trust is blocked, and all others are allowed.  Besides links in the html,
a host and the domain above it are linked both ways.  The walks go on
until what is left of them cannot move a score by half of MARGIN.

Defined cases: a null url, or one without `://`, has an empty host and
path, fits no rule and is allowed; null html has no links; repeated rows
repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

# The rules of the contract, (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
DAMPING = 0.85
#: Rounds of the SQL, which leave 3e-9 of the mass; the query goes on until the scores settle.
ROUNDS = 120
#: Rounds between two tables of ranks; their difference bounds what is left.
STRIDE = 8
#: Share of a round's new ranks; the rest stays.  The limit is the same, but ranks that swing
#: between a host and the domain above it settle sooner.
STEP = 0.75
#: Distrust must exceed trust by this, so that sums in another order agree.
MARGIN = 1e-9
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links, in any case, with either quote or none.
HREF = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Edges or hosts up to which they are broadcast; beyond it they are joined by key.
SMALL = 200_000


def _lower(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict; the longest fitting rule wins.

    The rules are a configured list and become one expression.
    """
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", "html", _lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    rule = said = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return parts.withColumn("rule", rule).withColumn("said", said)


def host_edges(judged: DataFrame) -> DataFrame:
    """src, dst, p: distinct links between hosts, each host's shares adding up to 1."""
    links = judged.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))).alias("to"))
    links = links.select(F.col("host").alias("src"), _lower(F.col("to")).alias("dst"))
    labels = F.split("host", r"\.")
    above = judged.select("host").distinct().where(F.size(labels) > 2).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(
            F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 2, F.size(labels)), ".").alias("b")
        ))).alias("x")
    )
    edges = links.unionByName(above.select(F.col("x.a").alias("src"), F.col("x.b").alias("dst"))).unionByName(
        above.select(F.col("x.b").alias("src"), F.col("x.a").alias("dst"))
    )
    return edges.where("src != dst and src != '' and dst != ''").distinct()


def scores(judged: DataFrame, damping: float = DAMPING, error: float = MARGIN / 2, margin: float | None = None) -> DataFrame:
    """host, trust, distrust: both walks in the same rounds, all scores together within `error` of their limits.

    With a `margin`, the walks also end when no host is reached anew and
    what is left can't change on which side of it any host's distrust
    less trust is.
    """
    edges = written(host_edges(judged), "host-edges")
    walks = edges.select(F.lit("t").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    out = walks.groupBy("kind", "src").agg(F.count("*").alias("n"))
    moves = walks.join(out, ["kind", "src"]).select("kind", "src", "dst", (STEP * damping / F.col("n")).alias("p"))
    pages = judged.where("said is not null and host != ''").groupBy("host", "said").agg(F.count("*").alias("n"))
    pages = written(pages, "host-seeds")
    total = {r[0]: r[1] for r in pages.groupBy("said").agg(F.sum("n")).collect()}
    share = F.when(F.col("said") == "allow", F.col("n") / total.get("allow", 1)).otherwise(F.col("n") / total.get("block", 1))
    seeds = pages.select(F.when(F.col("said") == "allow", "t").otherwise("d").alias("kind"), "host", share.alias("seed"))
    # What stays at a host is an edge to itself.
    hosts = walks.select("kind", F.explode(F.array("src", "dst")).alias("src")).unionByName(seeds.select("kind", F.col("host").alias("src"))).distinct()
    walks = written(moves.unionByName(hosts.select("kind", "src", F.col("src").alias("dst"), F.lit(1 - STEP).alias("p"))), "host-walks")
    side = F.broadcast(walks) if walks.count() <= SMALL else walks
    rank = seeds.withColumnRenamed("seed", "r")
    back = seeds.select("kind", "host", (F.col("seed") * (STEP * (1 - damping))).alias("r"))
    # A round shrinks the L1 distance to the limit to 1 - STEP (1 - damping) of it, so STRIDE
    # rounds that moved the ranks by d leave at most d * shrunk / (1 - shrunk).
    shrunk, left = (1 - STEP * (1 - damping)) ** STRIDE, float("inf")
    settled = False
    while left > error and not settled:
        before = rank
        for _ in range(STRIDE):
            moved = rank.withColumnRenamed("host", "src").join(side, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("r") * F.col("p")).alias("r")
            )
            rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        rank = written(rank, "host-ranks")
        both = rank.withColumn("now", F.lit(1)).unionByName(before.withColumn("now", F.lit(-1)))
        total_of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
        step, here = F.col("r") * F.col("now"), F.when(F.col("now") == 1, F.col("r"))
        hosts = both.groupBy("host").agg(
            (F.abs(total_of("t", step)) + F.abs(total_of("d", step))).alias("moved"), F.sum("now").alias("more"),
            total_of("t", here).alias("t"), total_of("d", here).alias("d"),
        )
        # Hosts without distrust can't be blocked once no host is reached anew.
        near = F.when(F.col("d") > 0, F.abs(F.col("d") - F.col("t") - F.lit(margin or 0.0)))
        change, more, nearest = hosts.agg(F.sum("moved"), F.sum("more"), F.min(near)).first()
        left = (change or 0.0) * shrunk / (1 - shrunk)
        settled = margin is not None and not more and (nearest is None or nearest > left)
        forget(before)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, for every page."""
    judged = with_rules(pages, rules)
    blocked = written(
        scores(judged, margin=MARGIN).where(F.col("distrust") > F.col("trust") + MARGIN).select("host", F.lit("block").alias("how")), "host-blocked"
    )
    side = F.broadcast(blocked) if blocked.count() <= SMALL else blocked
    return judged.drop("html").join(side, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "how", F.lit("allow")).alias("verdict")
    )


def op10(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _oracle() -> str:
    href = HREF.replace("'", "''")
    fit = "case " + " ".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h}{p}|{v}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ) + " end"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    parts = [
        f"""u as (select page_id, html, {lower(f"regexp_extract(coalesce(url, ''), '{URL}', 1)")} as host,
  regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages)""",
        f"j as materialized (select *, split_part(fit, '|', 1) as rule, nullif(split_part(fit, '|', 2), '') as said from (select *, {fit} as fit from u))",
        "hl as (select distinct host, string_split(host, '.') as l from j)",
        "ab as (select array_to_string(l[i:], '.') as a, array_to_string(l[i + 1:], '.') as b from (select l, unnest(range(1, len(l) - 1)) as i from hl))",
        f"""e as materialized (select distinct src, dst from (
  select host as src, {lower(f"unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1))")} as dst from j
  union all select a, b from ab union all select b, a from ab) where src <> dst and src <> '' and dst <> '')""",
        "w0 as (select 't' as kind, src, dst from e union all select 'd', dst, src from e)",
        "w as materialized (select kind, src, dst, 1.0::double / count(*) over (partition by kind, src) as p from w0)",
        """s as materialized (select case said when 'allow' then 't' else 'd' end as kind, host,
  count(*)::double / sum(count(*)) over (partition by said) as seed from j where said is not null and host <> '' group by said, host)""",
        "r0 as (select kind, host, seed as r from s)",
    ]
    for k in range(ROUNDS):
        parts.append(f"""r{k + 1} as materialized (select kind, host, sum(r) as r from (
  select w.kind, w.dst as host, r.r * w.p * {DAMPING}::double as r from r{k} r join w on r.host = w.src and r.kind = w.kind
  union all select kind, host, seed * (1 - {DAMPING}::double) from s) group by kind, host)""")
    parts.append(f"""b as (select host from r{ROUNDS} group by host
  having coalesce(sum(r) filter (where kind = 'd'), 0) > coalesce(sum(r) filter (where kind = 't'), 0) + {MARGIN}::double)""")
    return "with " + ",\n".join(parts) + """
select page_id, host, path, nullif(rule, '') as rule,
  coalesce(said, case when host in (select host from b) then 'block' else 'allow' end) as verdict from j"""


ORACLE = _oracle()
