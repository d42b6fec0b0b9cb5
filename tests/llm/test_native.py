"""Mixing, secret scan, sharding, exact dedup and URL filters against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sigmill.llm import exact_dedup, mixing, secrets, sharding, url_filters


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows]


def test_mix_reaches_targets(docs, rows):
    got = mixing.op4(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    for x, n in zip(rows, sizes(rows), strict=True):
        by[x[3]] += n
    names = sorted([s for s in by if s is not None]) + [None]
    # Water filling by brute force: raise the level until the total is met.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high, total = 0.0, 1e9, 1.5 * sum(by.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * by[s], mid * weight[s]) for s in names) < total else (low, mid)
    target = {s: min(2 * by[s], low * weight[s]) for s in names}
    assert {round(t, 6) for t in target.values()} == {round(r.target, 6) for r in got}
    assert abs(sum(r.taken for r in got) - total) <= 1
    taken = defaultdict(int)
    source = {x[0]: x[3] for x in rows if x[0] is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
    biggest = max(sizes(rows))
    for s in names:
        assert abs(taken[s] - target[s]) <= biggest + 200
    assert sorted(map(str, got)) == sorted(map(str, mixing.op4(docs.repartition(5)).collect()))


def test_mixed_stream_repeats_rows(docs, empty):
    served = mixing.mix(docs).agg(F.sum("served")).first()[0]
    out = mixing.mixed_stream(docs)
    assert out.columns == docs.columns and out.count() == served
    assert mixing.mixed_stream(empty).count() == 0 and mixing.op4(empty).count() == 0


def test_groups_that_fit_a_shard_are_whole(spark):
    rows = [(i, f"group {i % 90}" if i < 450 else f"single {i}") for i in range(1000)]
    got = sharding.op6(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    places = defaultdict(set)
    for r in got:
        if r.doc_id < 450:
            places[r.text_crc32].add(r.shard)
    assert len(places) == 90 and all(len(p) == 1 for p in places.values())


@pytest.fixture(scope="module")
def llr(docs):
    return secrets.train(secrets.labelled_samples(docs))


def test_base_spans_match_plain_regexes(docs, rows, llr):
    base = {
        "assign": (re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), lambda m: len(m[1]) >= 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    want = Counter()
    for doc_id, text, *_ in rows:
        found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(base.items()) for m in p.finditer(text or "") if ok(m)]
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        want[(doc_id, *(sum(f[3] == k for f in found) for k in base), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = secrets.op5(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert sum(r.n_assign for r in got) >= 1 and sum(r.n_access for r in got) == 1 and sum(r.n_hex for r in got) == 1


def test_many_matches_keep_their_positions(spark, llr):
    text = "é " + "0123456789abcdef0123456789abcdef " * 700
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = secrets.scan(df, llr).first()["hex"]
    assert [(s.s, s.e) for s in spans] == [(2 + 33 * i, 34 + 33 * i) for i in range(700)]


def test_markov_model_tells_random_from_ordinary(spark, llr):
    texts = {
        1: "zq8Xv3KpL0tRw9YbN2mHs7Gd4Fj", 2: "this_is_an_ordinary_identifier", 3: "UserAccountManagerFactory", 4: "kJ9-xQ2vT_7wLpZ0aBn3Re8Yc",
        5: "internationalisation-of-everything",
    }
    df = spark.createDataFrame([(k, f"see {v} there") for k, v in texts.items()], "doc_id bigint, text string")
    found = {r.doc_id: r.markov for r in secrets.scan(df, llr).collect()}
    assert [k for k, v in sorted(found.items()) if v] == [1, 4]
    assert tuple(found[1][0]) == (4, 4 + len(texts[1]))
    # The ratio agrees with the sum of table entries.
    at, n = {c: i for i, c in enumerate(secrets.ALPHABET)}, len(secrets.ALPHABET)
    want = sum(llr[at[a] * n + at[b]] for a, b in zip(texts[1], texts[1][1:]))
    got = spark.createDataFrame([(texts[1],)], "t string").select(secrets._ratio(F.col("t"), llr)).first()[0]
    assert got == pytest.approx(want)


def test_secrets_of_an_empty_table(empty):
    assert secrets.op5(empty).count() == 0


def test_shards_are_even_and_keep_groups(docs, rows, empty):
    got = sharding.op6(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((x[0], 8 + len((x[1] or "").encode()), None if x[1] is None else zlib.crc32(x[1].encode())) for x in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.op6(empty).count() == 0


def test_sharding_gathers_groups(spark):
    """Groups of 10 equal texts end in one shard, but for those that fill the gaps; a huge one is spread."""
    rows = [(i, f"group {i // 10}") for i in range(2400)] + [(10_000 + i, f"single {i}") for i in range(2400)] + [(20_000 + i, "huge") for i in range(2000)]
    got = sharding.op6(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    text = dict(rows)
    places = defaultdict(set)
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    groups = [len(v) for k, v in places.items() if k.startswith("group")]
    assert sum(n == 1 for n in groups) >= 0.95 * len(groups)
    assert len(places["huge"]) <= 24


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_matches_grouping(docs, rows, empty):
    first, size = {}, Counter()
    for x in rows:
        n = normal(x[1])
        size[n] += 1
        first[n] = min((y for y in (first.get(n), x[0]) if y is not None), default=None)
    want = Counter((x[0], first[normal(x[1])], size[normal(x[1])], hashlib.sha256(normal(x[1]).encode()).hexdigest()) for x in rows)
    got = exact_dedup.op8(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(size)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.op8(empty).count() == 0


def test_history_members_go_and_others_group(spark, docs):
    history = spark.createDataFrame([(900, "word"), (901, "never seen"), (902, "two  words")], "doc_id bigint, text string")
    got = exact_dedup.dedup(docs, history).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        if normal(r.text) in ("word", "two words"):
            assert not r.kept and r.keep_id in (900, 902)
        else:
            assert r.keep_id < 900
    assert any(r.kept for r in got)


def test_hot_digest_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 50)
    rows = [(i, "hot" if i % 2 else f"cold {i}") for i in range(2000)]
    got = exact_dedup.op8(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.kept for r in got) == 1001 and {r.keep_id for r in got if r.group_size == 1000} == {1}
    # The hot digest is no member of the history: all its rows come after the median.
    rows = [(i, f"cold {i}") for i in range(1200)] + [(i, "hot") for i in range(1200, 1900)] + [(None, "hot"), (None, "cold 3")]
    got = exact_dedup.op8(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.kept for r in got) == 1201 and Counter(r.keep_id for r in got)[1200] == 701
    assert [r.keep_id for r in got if r.group_size == 2] == [3, 3]


def test_perfect_hash_is_minimal():
    import numpy as np

    for n in (0, 1, 2, 1000, 20_000):
        keys = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
        sizes_, bits, slots = exact_dedup.build(keys)
        assert sorted(slots) == list(range(n)) == sorted(exact_dedup.look_up(keys, sizes_, bits)) if n else not len(slots)


PAGES = [
    ("https://A.example.org/es/x", "allow?"), ("http://example.org/es/1", ""), ("http://example.org/en/17", ""), ("http://sub.example.org/en/2", ""),
    ("https://shop.COM/fr/a?b#c", ""), ("https://shop.com/de/", ""), ("https://shop.com/en", ""), ("http://org", ""), (None, None), ("no scheme", ""),
    ("x://y://z/q", ""), ("https://net.net/#f", '<a href="https://shop.com/de/1">'), ("https://good.net/", '<a href="//trusted.org/">'), ("http://trusted.org/", '<a href="https://good.net/z">'),
    ("https://bad.net/p", '<a href="http://spam.com/de/">'), ("https://spam.com/de/9", ""),
]


def test_url_rules_and_propagation(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filters.op10(df).collect()}
    assert len(got) == len(rows)
    rules = [got[i].rule for i in range(8)]
    assert rules == ["example.org/es/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.org", "/es/x", "block")
    assert (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and got[9].host == ""
    assert (got[10].host, got[10].path) == ("y:", "//z/q")
    # Hosts that link to blocked ones inherit distrust, those that trusted ones link to inherit trust.
    assert got[14].verdict == "block" and got[12].verdict == "allow"
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = {tuple(x) for x in con.execute(url_filters.ORACLE).fetchall()}
    assert want == {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.values()}


def test_urls_of_an_empty_table(spark):
    assert url_filters.op10(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
