"""Whitening, quality ranking and source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sigmill.llm import divergence, quality, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, x string, component int, vector string"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    data = (r.normal(size=(300, 20)) @ r.normal(size=(20, 24)) / 5 + r.normal(size=(300, 24)) / 9).astype(np.float32)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)]
    rows += [(400 + i, rows[7][1]) for i in range(150)]  # a third of all are copies
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    bad = [None, [], [1.0] * 5, [float("nan")] * 24, [None] + [0.5] * 23, [float("inf")] + [0.5] * 23, [-float("inf")] + [0.5] * 23]
    return rows, [(900 + i, b) for i, b in enumerate(bad)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 7, "c") for i, v in rows], VECTORS).repartition(3)


def test_whitening_against_numpy(spark, vectors):
    good, bad = vectors
    got = whitening.op11(table(spark, good + bad)).toPandas()
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    centred = (n * u - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    want = ((n * x - s) / n) @ q / np.sqrt(e)
    assert len(got) == 16 * len(good) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    rows = {(i, tuple(v)): k for k, (i, v) in enumerate(good)}
    by = {}
    for key, part in got.groupby(["vec_id", "deviation"], dropna=False):
        by[key] = part.sort_values("component").whitened.to_numpy()[:: len(part) // 16]
    for (i, _), k in rows.items():
        mine = by[(float("nan") if i is None else i, int(((n * x[k] - s) ** 2).sum()))] if i is not None else None
        if mine is not None:
            assert np.abs(np.abs(mine) - np.abs(want[k])).max() < 1e-9
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (e / np.trace(centred.T @ centred / n)) - 1).max() < 1e-9
    # One sign for all rows: the whitened vectors are uncorrelated.
    z = np.array([by[(i, int(((n * x[k] - s) ** 2).sum()))] for (i, _), k in rows.items() if i is not None and i < 300])
    assert abs(z[:, 0] @ z[:, 1]) / n < 0.1


def test_whitening_of_few_dimensions_and_none(spark, vectors):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(35)]
    got = whitening.op11(table(spark, rows)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9  # the third never varies
    assert abs(got.groupby("component").explained.first().sum() - 1) < 1e-9
    for none in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], vectors[1][:2]):
        out = whitening.op11(table(spark, none))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_beyond_longs():
    m = whitening.Whitening(10**7, [10**13 + 5, 3], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[10**6 + 40, -9], [1 << 46, 1 << 46]], np.int64)
    want = [sum((10**7 * int(v) - s) ** 2 for v, s in zip(row, m.sums)) for row in x]
    assert [int(v) for v in m.squares(m.deviations(x))] == want
    assert m.squares(m.deviations(x[:0])).shape == (0,)


def test_whitening_far_from_zero(spark):
    """Unit spread at an offset of 1e8: uncentred products would keep no digit of it."""
    r = np.random.default_rng(4)
    rows = [(i, [1e8 + float(v) for v in r.integers(-3, 4, 3)]) for i in range(200)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.op11(data).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error.max() < 1e-9


def _prose(r, words, n):
    return " ".join(r.choice(words).capitalize() if i % 9 == 0 else r.choice(words) for i in range(n)) + "."


@pytest.fixture(scope="module")
def judged(words):
    r = random.Random(9)
    junk = [
        lambda: " ".join(w.upper() + "!!" for w in _prose(r, words, r.randint(10, 60)).split()),
        lambda: " | ".join(_prose(r, words, r.randint(10, 60)).split()),
        lambda: " ".join(w for w in r.sample(words, 6) for _ in range(r.randint(5, 12))),
        lambda: " ".join(w + r.choice(["***", "$$$", "%%%"]) for w in _prose(r, words, r.randint(10, 60)).split()),
    ]
    texts, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        texts.append(_prose(r, words, r.choice([8, 40, 400])) if good else junk[i // 3 % 4]())
        labels.append(int(good) if i % 17 else 1 - int(good))  # some are wrong
    return texts, labels


def test_quality_of_the_held_out(spark, judged, words):
    texts, labels = judged
    truth = [int(i % 3 > 0) for i in range(600)]
    rows = [(i, t, "en", "s", 1, 0, 0.5) for i, t in enumerate(texts)]
    rows += [(700, None, "en", "s", 0, 1, 0.1), (701, " \n", "en", "s", 0, 1, 0.1), (702, _prose(random.Random(2), words, 30_000), None, None, 0, 0, 0.0), rows[4], rows[4], (None, texts[2], "de", "s", 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, y int, quality int, score double").repartition(3)
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None), (4, 7), (5, 0), (5, 1)], "doc_id bigint, quality int").repartition(2)
    got = quality.op12(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert by[700].score == by[701].score == 0 and by[702].predicted == 1
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    model = quality.fit(docs, marks)
    top = quality.best_share(docs, model, 0.25).collect()
    assert 0.2 < len(top) / len(rows) < 0.35 and min(r.score for r in top) >= sorted((r.score for r in got), reverse=True)[len(top) - 1] - 1e-12


def test_quality_without_lessons(spark, judged):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    for rows in ([], [(1, 1), (2, None)]):
        got = {r.doc_id: (r.score, r.predicted) for r in quality.op12(docs, spark.createDataFrame(rows, "doc_id bigint, quality int")).collect()}
        assert got == {1: (0.5, 1), 2: (0.0, 0)}
    named = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    assert quality.op12(named, spark.createDataFrame([("a", 1)], "doc_id string, quality int")).count() == 1
    assert quality.op12(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 0


def test_ranking_maximises_the_likelihood():
    r = np.random.default_rng(1)
    d = r.normal(size=(500, 4)) + [0.8, -0.3, 0, 0.1]
    w = quality.bradley_terry(d, 1e-2)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 5e-3 * w @ w
    assert all(loss(w) <= loss(w + 1e-3 * r.normal(size=4)) for _ in range(200))


def test_features_by_pieces_are_those_of_the_whole(monkeypatch, judged):
    texts = pa.array([judged[0][1], None, "", "\n\n a", " ".join(judged[0][:40]), "é" * 3000])
    whole = quality.features(texts)
    assert len(whole[0][0]) == quality.FEATURES and list(whole[1]) == [True, False, False, True, True, True]
    one = np.concatenate([quality.features(texts.slice(i, 1))[0] for i in range(len(texts))])
    assert np.allclose(whole[0], one)
    words = judged[0][4].split()
    kinds = Counter(judged[0][4].encode())
    assert np.isclose(quality.features(pa.array([judged[0][4]]))[0][0][3] ** 2, kinds[32] / len(judged[0][4].encode())) and words


def _divergence(rows):
    """The contract, term by term."""
    found = [(x[2] or "", x[3] or "", [m.translate({i: i + 32 for i in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x[1] or "")]) for x in rows]
    out = set()
    for lang in {f[0] for f in found}:
        mine = [f for f in found if f[0] == lang]
        df = Counter(t for f in mine for t in set(f[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if t in set(kept))
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        for source in count:
            pairs = [(sum(f(share(count[source], t), share(count[o], t)) for t in kept), o) for o in count if o != source]
            terms = [(f(share(count[source], t), share(whole, t)), t) for t in kept if count[source][t] and share(count[source], t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, source, part, item, v, k + 1))
    return out


def test_divergence_against_the_contract(spark, docs, rows, empty):
    got = divergence.op13(docs).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == _divergence(rows)
    assert divergence.op13(empty).count() == 0


def test_divergence_of_groups_without_terms(spark):
    rows = [(i, t, lang, s) for i, (t, lang, s) in enumerate([("Ab ab aé", "x", "p")] * 4 + [("AB q", "x", "q"), ("12 34", "x", "r"), (None, "x", None), ("only here", "y", "p"), (None, "y", "q"), ("", None, None)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = divergence.op13(docs).collect()
    assert set(map(tuple, got)) == _divergence(rows) and {r.value for r in got if r.lang == "y"} == {0}
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes())
    want = con.execute(divergence.ORACLE).df()
    assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in want.itertuples()} == set(map(tuple, got))


def test_terms_in_pieces(monkeypatch):
    text = "Zwölf Boxkämpfer jagen x1y ÄÖ 中文 " * 50
    whole = [t for part in divergence.terms(text.encode()) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for part in divergence.terms(text.encode()) for t in part] == whole
    monkeypatch.setattr(divergence, "HELD", 1)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", ""]), pa.array(["s", "s", "t"]), pa.array(["b b c", None, "B"])], ["lang", "source", "text"])
    rows = [tuple(r.values()) for out in divergence._count(iter([batch, batch])) for r in out.to_pylist()]
    assert Counter({(r[0], r[1], r[2]): 1 for r in rows}).keys() == {("a", "s", None), ("a", "s", b"b"), ("a", "s", b"c"), ("", "t", None), ("", "t", b"b")}
    assert sum(r[3] for r in rows if r[2] == b"b") == 6 and sum(r[4] for r in rows if r[2] == b"b") == 4
