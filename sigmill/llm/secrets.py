"""Secret scan: fixed patterns plus a character Markov model (native).

Two character bigram models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a long token is a secret
when its log-likelihood ratio reaches the threshold.  Spans count code
points, end exclusive.

Defined cases: null text is empty and has no spans; matches of a kind
don't overlap; a Markov span that touches a span of the fixed patterns is
left out; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in their order, and the patterns of the contract.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: `X+` of n or more characters, in a run that is always taken whole.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that the model judges: whole runs of these characters.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_LEAST = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}+"
#: Nats by which a random string must be likelier than an identifier.
THRESHOLD = 8.0
#: Bound of the labelled sample: documents whose words serve as identifiers.
SAMPLE_DOCS = 300
RANDOM_ROWS = 2000
#: Matches whose positions are summed in one go.
CHUNK = 256

SPAN = "array<struct<s:int,e:int>>"


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_rows: int = RANDOM_ROWS) -> DataFrame:
    """(label, token): 'random' strings made from digests; 'ordinary' words and identifiers.

    Ordinary ones are alphabetic words of about `sample_docs` documents,
    chosen by a hash of the whole row, alone and joined to snake, kebab
    and path forms with short numbers.
    """
    spark = docs.sparkSession
    of = docs.select("text")
    share = min(1.0, sample_docs / max(1, of.count()))
    few = of.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).distinct()
    words = few.select(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w])[A-Za-z]{3,19}(?![\w])"), F.lit(0))).alias("w"))
    word = F.col("x")
    at = lambda i: F.try_element_at("w", (F.pmod(F.xxhash64(word, F.lit(i)), F.size("w")) + 1).cast("int"))
    num = F.pmod(F.xxhash64(word, F.lit("n")), F.lit(2030)).cast("string")
    forms = F.array(
        word, F.concat_ws("_", word, at(1)), F.concat_ws("-", at(2), word, num), F.concat_ws("/", word, at(3), at(4)),
        F.concat(word, F.initcap(at(5))), F.concat_ws("_", F.upper(word), F.upper(at(6))),
    )
    ordinary = words.select("w", F.explode("w").alias("x")).select(F.lit("ordinary").alias("label"), F.explode(forms).alias("token"))
    seed = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(seed))
    strings = F.array(
        seed, F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 40), b64, F.translate(b64, "+/", "-_"),
        F.upper(F.regexp_replace(b64, "[+/=]", "")),
    )
    random = spark.range(random_rows).select(F.lit("random").alias("label"), F.explode(strings).alias("token"))
    return ordinary.unionByName(random)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the next character given the last.

    The table has len(ALPHABET)**2 entries, row by row; counts are
    smoothed by one.  Samples may be of any number: only pair counts
    leave the cluster.
    """
    at, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2))))
    rows = samples.where(F.length("token") > 1).select("label", pair.alias("pair")).groupBy("label", "pair").count()
    bare = "[^" + "".join("\\" + c if c in "-" else c for c in ALPHABET) + "]"
    rows = rows.where(~F.col("pair").rlike(bare)).collect()
    count = {"random": [1.0] * (n * n), "ordinary": [1.0] * (n * n)}
    for label, text, times in rows:
        count[label][at[text[0]] * n + at[text[1]]] += times
    out = [0.0] * (n * n)
    for a in range(n):
        r, o = (sum(count[k][a * n : a * n + n]) for k in ("random", "ordinary"))
        for b in range(n):
            i = a * n + b
            out[i] = round(math.log(count["random"][i] / r) - math.log(count["ordinary"][i] / o), 6)
    return out


def _positions(pieces: str, found: str) -> Column:
    """Spans of all matches, from the pieces between them and the matches."""
    arr = f"transform({found}, (m, i) -> struct(length({pieces}[i]) as p, length(m) as m))"
    chunks = (
        f"transform(sequence(0, cast((size(_l) - 1) div {CHUNK} as int)), c -> slice(_l, c * {CHUNK} + 1, {CHUNK}))"
    )
    totals = "transform(_c, c -> aggregate(c, 0, (a, x) -> a + x.p + x.m))"
    begins = "aggregate(_t, struct(0 as a, cast(array() as array<int>) as o), (z, x) -> struct(z.a + x as a, concat(z.o, array(z.a)) as o), z -> z.o)"
    spans = (
        f"flatten(transform(_c, (c, i) -> aggregate(c, struct(_b[i] as a, cast(array() as {SPAN}) as o),"
        f" (z, x) -> struct(z.a + x.p + x.m as a, concat(z.o, array(struct(z.a + x.p as s, z.a + x.p + x.m as e))) as o), z -> z.o)))"
    )
    bind = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    return F.expr(bind("_l", arr, bind("_c", chunks, bind("_t", totals, bind("_b", begins, spans)))))


def scan(docs: DataFrame, llr: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the spans of each kind, arrays of (s, e), in text order."""
    none = F.array().cast(SPAN)
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern, may in (
        ("assign", ASSIGN, F.col("text").contains("=") | F.col("text").contains(":")),
        ("access", ACCESS, F.col("text").contains("AKIA")),
        ("hex", HEX, F.lit(True)),
        ("markov", TOKEN, F.lit(True)),
    ):
        empty = F.array().cast("array<string>")
        out = out.withColumn("_f", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
        out = out.withColumn("_p", F.when(F.size("_f") > 0, F.split("text", pattern, -1)).otherwise(empty))
        out = out.withColumn("_s", F.when(F.size("_f") > 0, _positions("_p", "_f")).otherwise(none))
        if kind == "assign":
            values = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
            out = out.withColumn("_v", F.when(F.size("_f") > 0, values).otherwise(empty))
            keep = f"filter(_s, (x, i) -> length(_v[i]) >= {ASSIGN_LEAST})"
        elif kind == "markov":
            out = out.withColumn("_v", F.transform("_f", lambda t: _ratio(t, llr)))
            base = "concat(assign, access, hex)"
            keep = f"filter(_s, (x, i) -> _v[i] >= {threshold}D and not exists({base}, b -> b.s < x.e and x.s < b.e))"
        else:
            keep = "_s"
        out = out.withColumn(kind, F.expr(keep))
    return out.select("doc_id", *KINDS)


def _ratio(token: Column, llr: list[float]) -> Column:
    """Sum of the table's entries over the token's pairs."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, llr))), ",").cast("array<double>")
    code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(code, F.lit(1), F.size(code) - 1), F.slice(code, F.lit(2), F.size(code) - 1), lambda a, b: a * n + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get(table, i))


def joined(*kinds: str) -> Column:
    """kind:start:end of the spans by start, then kind as listed."""
    tagged = [
        f"transform({k}, x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e))" for k in kinds
    ]
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    text = f"transform(array_sort(concat({', '.join(tagged)})), x -> concat({names}[x.k], ':', x.s, ':', x.e))"
    return F.array_join(F.expr(text), ",")


def op5(docs: DataFrame) -> DataFrame:
    spans = scan(docs, train(labelled_samples(docs)))
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
    )
