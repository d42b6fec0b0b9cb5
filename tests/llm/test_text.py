"""Line dedup, language ID, decontamination, near dedup, token counts and the pipeline against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmill.llm import decontaminate, graph, language_id, line_dedup, linking, myers, near_dedup, token_counts
from sigmill.llm import textkernel as K

SPACE = r"[\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def split(text):
    return [w for w in re.split(SPACE, lower(text)) if w]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def plain_distance(a, b, free=False):
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[1:] if free else row[-1]


def test_myers_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(500):
        a = [r.choice("abc") for _ in range(r.randint(1, 90))]
        b = [r.choice("abc") for _ in range(r.randint(0, 90))]
        assert myers.distance(a, b) == plain_distance(a, b)
        assert myers.ends(myers.masks(a), len(a), b) == plain_distance(a, b, True)


def test_word_kernel(rows):
    texts = [x[1] or "" for x in rows]
    data, offsets = K.buffers(pa.array(texts))
    for size in (1000, 1 << 20):
        seen = []
        for a, b in K.blocks(offsets, size):
            hashes, starts, ends, firsts = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = data[offsets[a] : offsets[b]].tobytes()
            for i in range(b - a):
                words = [lower(raw[s:e].decode()) for s, e in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]])]
                assert words == split(texts[a + i])
                seen += zip(words, hashes[firsts[i] : firsts[i + 1]].tolist())
        by = {}
        for w, h in seen:
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_components(spark):
    r = random.Random(3)
    for n, m in ((50, 30), (200, 150), (60, 200)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)]
        got = {x.node: x.comp for x in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        want = components({x for link in links for x in link}, links)
        assert got == {k: v for k, v in want.items() if any(k in link and link[0] != link[1] for link in links)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_buckets_find_every_shared_band(spark):
    r = random.Random(4)
    rows = {(r.randrange(60) if i % 3 else 7, i) for i in range(3000)} | {(1000 + i, i) for i in range(2000)}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = linking.buckets(spark.createDataFrame(sorted(rows), "band bigint, node bigint")).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        by = {}
        for band, node in rows:
            by.setdefault(band, set()).add(node)
        want = {(b, n, min(v)) for b, v in by.items() if len(v) > 1 for n in v}
        assert {tuple(x) for x in got} == want


def shingles(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values())


def test_near_classes_equal_all_pairs(docs, rows, empty):
    sets = {(x[0], i): shingles(x[1]) for i, x in enumerate(rows)}
    links = [(p, q) for p, q in itertools.combinations(sorted(sets, key=lambda k: (k[0] is None, k)), 2) if sets[p] and sets[q] and similar(sets[p], sets[q])]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for p, q in links:
        a, b = sorted((find(p), find(q)), key=lambda k: (k[0] is None, k))
        if a != b:
            parent[b] = a
    sizes = Counter(find(p) for p in sets)
    want = Counter((p[0], find(p)[0], sizes[find(p)]) for p in sets)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.op7(docs).collect()) == want
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(sizes)
    assert near_dedup.op7(empty).count() == 0 and near_dedup.first_of_each(empty).count() == 0


def test_family_of_near_copies_is_one_class(spark, words):
    """Copies that differ from each other too much are linked through the text they were made from."""
    r = random.Random(9)
    base = [r.choice(words) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(3):
            w[r.randrange(150)] = f"x{i}{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(r.choice(words) for _ in range(100))) for i in range(50)]
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])])
    got = near_dedup.op7(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == want and len(set(want.values())) < 60


def test_signatures_estimate_weighted_similarity(words):
    r = random.Random(2)
    a = [r.choice(words) for _ in range(400)]
    b = list(a)
    for i in range(0, 400, 40):
        b[i] = "other"
    pair = pa.array([" ".join(a), " ".join(b), " ".join(a), ""])
    (coords, weight, node), = near_dedup.signatures(pair)
    x, y = shingles(pair[0].as_py()), shingles(pair[1].as_py())
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((coords[0] == coords[1]).mean() - true) < 0.15
    assert (coords[0] == coords[2]).all() and (node[0] == node[2]).all() and (node[0] != node[1]).any() and weight.tolist() == [396, 396, 396, 0]
    assert near_dedup.similarity(pair[:1], pair[1:2])[0] == pytest.approx(true)


def test_kernels_take_few_words():
    for n in range(7):
        text = pa.array([" ".join("abcdefg"[:n])])
        (coords, weight, _), = near_dedup.signatures(text)
        assert weight[0] == min(n, 1 + max(0, n - 5)) and (coords[0] != 0).all() == (n > 0)
        assert near_dedup.similarity(text, text)[0] == (n > 0)


def test_one_row_per_partition(spark):
    """Blocks of few words, which each partition then has."""
    texts = ["a b c d e f", "a b c d e f", "a b c", "a b", "a", None, "", "x y z a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8, "doc_id")
    assert {x.doc_id: x.class_id for x in near_dedup.op7(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    bench = spark.createDataFrame([(1, "a b"), (2, "x y z a b c d e f")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.op3(df, bench).collect()} == {(i, 1) for i in (0, 1, 2, 3, 7)} | {(7, 2)}


def test_first_of_each_keeps_clashing_columns_and_text_ids(spark):
    rows = [("p", "a b c d e f g", 1, 2, 3, "s"), ("q", "a b c d e f g", 4, 5, 6, "t"), (None, "other words than those of before", 7, 8, 9, "u")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id string, text string, stays int, tag int, key int, all string")
    got = near_dedup.first_of_each(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_line_dedup_equals_all_pairs(docs, rows, empty, spark, words):
    def check(df, rows):
        lines, texts = [], {}
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        for i in order:
            for j, line in enumerate((rows[i][1] or "").split("\n")):
                if n := " ".join(split(line)):
                    lines.append((rows[i][0], i, j, n))
                    texts.setdefault(n, len(texts))
        names = list(texts)
        alike = lambda x, y: min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and myers.distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9
        links = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if alike(names[a], names[b])]
        comp = components(range(len(names)), links)
        seen, gone = set(), Counter()
        for doc, _, _, n in lines:
            gone[doc] += comp[texts[n]] in seen
            seen.add(comp[texts[n]])
        got = line_dedup.op1(df).collect()
        assert len(got) == len(rows)
        dropped = Counter()
        for x in got:
            dropped[x.doc_id] += len(x.dropped)
            assert x.n_kept == x.n_lines - len(x.dropped)
        assert +dropped == +gone
        return links

    check(docs, rows)
    r = random.Random(8)
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    near = [b.replace(" ", "  ").upper() for b in base] + [b[:-1] + "q" for b in base] + [b + " end" for b in base]
    some = [(i, "\n".join(r.choice(base + near) for _ in range(4))) for i in range(30)]
    assert check(spark.createDataFrame(some, "doc_id bigint, text string"), some)
    assert line_dedup.op1(empty).count() == 0
    out = line_dedup.without_repeats(spark.createDataFrame([(1, "one line\ntwo\none line"), (2, "two\n\nthree"), (3, None)], "doc_id bigint, text string"))
    assert {tuple(x) for x in out.collect()} == {(1, "one line\ntwo"), (2, "\nthree"), (3, None)}


@pytest.mark.parametrize("n", [1, 5, 8, 14, 15, 40, 300])
def test_line_candidates_at_the_threshold(n, words):
    """Lines with as many words replaced as an edit similarity of 0.8 allows: 0.9 or more are candidates."""
    r, ones, others = random.Random(n), [], []
    while len(ones) < 60:
        new = [r.choice(words) for _ in range(n)]
        x = y = " ".join(new)
        for i in r.sample(range(n), n):
            more = [*new[:i], r.choice(words) if n > 1 else new[0][:-1] + "q", *new[i + 1 :]]
            if myers.distance(x, " ".join(more)) > 0.2 * max(len(x), len(" ".join(more))):
                break
            new, y = more, " ".join(more)
        if x != y:
            ones.append(x)
            others.append(y)
    data, offsets = K.buffers(pa.array(["\n".join(ones + others)]))
    _, _, count, plain, at, hashes, firsts = line_dedup.plain_lines(data, offsets)
    line, key = line_dedup.line_keys(count, plain, at, hashes, firsts)
    keys = [set(key[line == i].tolist()) for i in range(len(count))]
    bits = np.unpackbits(line_dedup.sim_hashes(plain, at).view(np.uint8), axis=1).astype(int)
    x, y = bits[: len(ones)], bits[len(ones) :]
    close = (x != y).sum(axis=1) <= np.minimum(line_dedup.BITS, line_dedup.SHARE * (x + y).sum(axis=1) + line_dedup.EVEN)
    assert np.mean([bool(keys[i] & keys[len(ones) + i]) and close[i] for i in range(len(ones))]) >= 0.9


@pytest.mark.parametrize("hot", [10, 500])
def test_large_buckets_of_lines_lose_no_link(spark, monkeypatch, hot):
    """Lines of one word that share seven tenths, so that their buckets hold all of them; each has one partner."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(31)
    letters = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    shared, lines = letters(1400), []
    for _ in range(60):
        own = letters(600)
        # Every piece of 12 bytes of its own part is another one in the partner.
        lines += [shared + own, shared + "".join("x" if i % 12 == 0 else c for i, c in enumerate(own))]
    got = line_dedup.op1(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    assert {x.doc_id for x in got if x.dropped} == set(range(1, 120, 2))


def test_candidates_of_a_bucket_are_never_rows(spark, monkeypatch):
    """Lines that share seven tenths and aren't similar: no table has a row for each pair of them."""
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", counted)
    r = random.Random(32)
    letters = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    shared = letters(420)
    lines = [shared + letters(180) for _ in range(120)]
    lines.append(lines[7][:-100] + "x" * 100)
    got = line_dedup.op1(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    assert {x.doc_id for x in got if x.dropped} == {j for j in range(121) if any(myers.within(lines[i], lines[j], 120) for i in range(j))}
    assert max(sizes.values()) < 3000 < 120 * 119 // 2


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_windows_of_distances_lose_no_pair(monkeypatch, few):
    """Near the limit, with parts moved and put in, so that paths stray from the diagonal."""
    monkeypatch.setattr(myers, "FEW", few)
    r, ones, others, most = random.Random(23), [], [], []
    for _ in range(400):
        x = "".join(r.choice("abcdé") for _ in range(r.choice((1, 63, 64, 65, 130, 300, 700))))
        y = "".join(c if r.random() > 0.1 else r.choice(("", "b", "xy")) for c in x)
        at, n = r.randrange(len(y) + 1), r.randrange(40)
        y = y[:at] + "q" * n + y[at:] if r.random() < 0.5 else y[n:] + "z" * n
        ones.append(x)
        others.append(y)
        most.append(max(0, myers.distance(x, y) + r.choice((-1, 0, 0, 3))))
    want = [myers.distance(x, y) <= k for x, y, k in zip(ones, others, most, strict=True)]
    assert 0.1 < np.mean(want) < 0.9 and myers.all_within(ones, others, most).tolist() == want


def test_distances_together_equal_those_one_by_one():
    r, ones, others = random.Random(22), [], []
    for _ in range(3000):
        ones.append("".join(r.choice("abcé漢") for _ in range(r.choice((1, 40, 63, 64, 65, 130, 190)))))
        others.append("".join(c if r.random() > 0.15 else r.choice(("", "b", "xy")) for c in ones[-1]))
    most = [int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(ones, others, strict=True)]
    got = myers.all_within(ones, others, most)
    assert 0 < got.mean() < 1 and got.tolist() == [myers.within(*x) for x in zip(ones, others, most, strict=True)]


def test_bounded_distance_equals_dynamic_programming():
    r = random.Random(21)
    for _ in range(400):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 25))) for _ in range(2))
        for most in (0, 2, 5, 30):
            assert myers.within(a, b, most) == (plain_distance(a, b) <= most)


def test_leaks_equal_dynamic_programming(spark, words):
    r = random.Random(11)
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate((8, 12, 20, 37, 60, 90))] + [(6, "too short"), (7, None), (8, "")]
    docs = []
    for i in range(60):
        w = items[i % 6][1].split()
        for _ in range(r.randint(0, len(w) // 4)):
            at, what = r.randrange(len(w)), r.randrange(3)
            w[at : at + (what != 0)] = [] if what == 1 else [r.choice(words)]
        docs.append((i, " ".join(prose(r.randint(0, 50))) + " " + (", " if i % 2 else "\n").join(w).upper() + " " + " ".join(prose(r.randint(0, 50)))))
    docs += [(100, None), (101, ""), (102, " ".join(prose(5000)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("distance", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.op3(df, bench).collect()
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    want = {}
    for d, text in docs:
        for i, item in items:
            p, t = tokens(item), tokens(text)
            if len(p) >= 8 and t:
                best = min(plain_distance(p, t, True))
                if best <= len(p) // 5:
                    want[d, i] = best
    found = {}
    for x in got:
        found[x.doc_id, x.item_id] = min(found.get((x.doc_id, x.item_id), 99), x.distance)
        part = tokens(dict(docs)[x.doc_id][x.start : x.end])
        assert plain_distance(tokens(dict(items)[x.item_id]), part) == x.distance
    assert found == want and len(want) > 30
    assert Counter(len([x for x in got if x.doc_id == d]) for d, _ in want) == Counter({1: len(want)})
    clean = decontaminate.without_leaks(df, bench)
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} and clean.columns == df.columns
    assert decontaminate.op3(df, bench.limit(0)).count() == 0 and decontaminate.op3(df.limit(0), bench).count() == 0


SYLLABLES = {"xx": "the and ing ou st th er", "yy": "der ung sch ei ich zu ß", "zz": "ción os la ue ñ el do"}


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(12)
    rows = []
    for i in range(600):
        lang = "xyz"[i % 3] * 2
        text = " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 200)))
        rows.append((i, text, lang if i % 7 else None, "s"))
    rows += [(1000, None, "xx", "s"), (1001, "123 --- 45", "xx", "s"), (1002, "", None, "s"), (None, "the and the", "xx", "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_language_of_held_out_documents(languages):
    got = language_id.op2(languages).join(languages, "doc_id").collect()
    held = [x for x in got if x.held_out and x.lang and x.doc_id < 600]
    assert len(held) > 50 and np.mean([x.lang_pred == x.lang for x in held]) > 0.97
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x.score <= 1 for x in got) and language_id.op2(languages).count() == languages.count()
    kept = language_id.recognised(languages)
    assert kept.columns == languages.columns and kept.count() == languages.count() - 3


def test_filter_rejects_what_is_no_language(languages, spark):
    """Texts of random letters or with shuffled letters go; clean ones stay."""
    r = random.Random(3)
    mixed = ["".join(r.sample(x.text, len(x.text))) for x in languages.where("doc_id < 40 and length(text) > 300").collect()]
    odd = [*mixed, "".join(r.choice("bcdfghjklmnpqrtvwxz ") for _ in range(900)), bytes(r.randrange(256) for _ in range(600)).hex()]
    more = languages.unionByName(spark.createDataFrame([(2000 + i, t, None, "s") for i, t in enumerate(odd)], languages.schema))
    kept = {x.doc_id for x in language_id.recognised(more).collect()}
    assert sum(i in kept for i in range(600)) >= 598 and sum(2000 + i in kept for i in range(len(odd))) <= 0.1 * len(odd)
    assert language_id.recognised(languages, languages=("xx",)).where("doc_id % 3 != 0 and doc_id < 600").count() <= 8
    blank = languages.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.recognised(blank).count() == languages.count() - 3


def test_bound_of_no_language_is_that_of_all_held_out_texts(languages, monkeypatch):
    model = language_id.fit(languages)
    tested = languages.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & language_id.held_out(F.col("doc_id")))
    texts = sorted({x.text for x in tested.collect()})
    none = language_id._judged(model, model.tables(), pa.array(texts, pa.large_string()), np.ones(len(texts), bool))[2]
    alone = [language_id._judged(model, model.tables(), pa.array([x], pa.large_string()), np.ones(1, bool))[2][0] for x in texts]
    assert none == pytest.approx(alone, rel=1e-5)
    for tail in (0.0, 0.1, 0.5):
        monkeypatch.setattr(language_id, "NONE", 0.0)
        monkeypatch.setattr(language_id, "TAIL", tail)
        assert language_id.most_none(languages, model) == pytest.approx(np.sort(none)[::-1][int(tail * len(none))], rel=1e-5)
    monkeypatch.setattr(language_id, "NONE", 0.98)
    assert language_id.most_none(languages.union(languages), model) >= 0.98


def test_prediction_sees_only_the_text_and_all_of_it(spark, languages):
    model = language_id.fit(languages)
    long = "the and ing " * 50 + "der ung sch ich zu ß ei " * 20_000
    rows = [(1, long), (2, "the and ing ou " * 30)]
    got = {x.doc_id: x.lang_pred for x in language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got == {1: "yy", 2: "xx"}


def test_network_equals_plain_convolution(languages):
    model = language_id.fit(languages)
    text = "der ung the ción ou ñ zu 12! " * 30
    raw = np.frombuffer(text.encode(), np.uint8)
    got = model.predict(raw, np.array([0, len(raw)]), model.tables())[0]
    n = -(-(len(raw) + 3) // language_id.WINDOW)
    code = np.zeros(n * language_id.WINDOW + 4, int)
    code[: len(raw)] = language_id.CLASS[raw]
    logs = []
    for w in range(n):
        feats = []
        for width, table in zip(language_id.WIDTHS, model.filters):
            conv = [sum(table[j][code[p + j]] for j in range(width)) for p in range(w * language_id.WINDOW, (w + 1) * language_id.WINDOW)]
            feats.append(np.max(conv, axis=0))
        z = np.maximum(np.concatenate(feats), 0) @ model.weights + model.bias
        logs.append((z - z.max() - np.log(np.exp(z - z.max()).sum())) * np.clip(len(raw) - w * language_id.WINDOW, 1, language_id.WINDOW))
    size = sum(np.clip(len(raw) - w * language_id.WINDOW, 1, language_id.WINDOW) for w in range(n))
    assert got == pytest.approx(np.sum(logs, axis=0) / size, abs=1e-3)


def test_no_labels_is_undetermined(spark, empty):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert language_id.op2(df).first()["lang_pred"] == "und"
    assert language_id.op2(empty).count() == 0


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.DEFAULT, "rb") as f:
        return token_counts.Counter(f.read())


def test_token_counts_equal_full_encoding(docs, rows, counter, empty):
    full = lambda t: len(counter.bpe.encode_ordinary(t))
    want = Counter((x[0], len(x[1] or ""), full(x[1] or ""), full(token_counts.MASKED.sub("0", x[1] or ""))) for x in rows)
    assert Counter((x.doc_id, x.n_chars, x.n_tokens, x.n_tokens_edited) for x in token_counts.op9(docs).collect()) == want
    assert token_counts.op9(empty).count() == 0


def test_edits_equal_full_encoding(counter):
    r = random.Random(0)
    letters = "ab '  \n\n s'll12é.,!\t"
    for k in range(400):
        tree = token_counts.TokenTree("".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 300, 2000]))), counter)
        for _ in range(8):
            a = r.randint(0, len(tree.text))
            b = min(len(tree.text), a + r.choice([0, 0, 1, 3, 40, 5000]))
            tree.edit(a, b, "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 8, 30]))))
            assert tree.total == len(counter.bpe.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_small_edit_of_a_long_text_encodes_little_again(counter):
    tree = token_counts.TokenTree("some plain words here " * 5000, counter)
    assert tree.edit(50_000, 50_003, "new") < 100


def test_pipeline_stages(spark, docs, rows, words, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    item = " ".join(r.choice(words) for _ in range(30))
    extra = spark.createDataFrame([(500, "before it " + item + " after it", "en", "a", 0, 1, 2)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    now, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
        if name != "shard":
            assert now.columns == docs.columns
    stage = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert counts[0] == sum(bool(re.search(r"[^\W\d_]", x[1] or "")) for x in rows) + 1
    assert counts[1] == len({tuple(sorted(c.items())) for c in map(shingles, (x.text for x in stage("near_dedup").collect()))})
    assert 500 in {x.doc_id for x in stage("near_dedup").collect()} and counts[2] == counts[1] - 1
    assert 500 not in {x.doc_id for x in stage("decontaminate").collect()}
    kept = Counter(x.doc_id for x in stage("mix_sources").collect())
    assert max(kept.values()) == 2 and sum(kept.values()) == counts[4]
    sizes = Counter(x.shard for x in now.collect())
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
