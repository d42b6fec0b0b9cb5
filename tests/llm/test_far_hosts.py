"""Host scores that need many rounds, and links in all their forms."""

import numpy as np
import pytest

from sigmill.llm import url_filters

RULES = (("good.test", "/", "allow"), ("bad.test", "/", "block"))


def page(i, host, *links):
    return (i, f"http://{host}/", "".join(links))


def test_hosts_many_links_from_a_seed_are_judged(spark):
    names = ["good.test", *(f"h{i}.test" for i in range(24)), "bad.test"]
    hosts = [*names, "other.test"]
    rows = [page(i, a, f'<a href="//{b}/">') for i, (a, b) in enumerate(zip(names, names[1:] + ["good.test"]))] + [page(99, "other.test")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    judged = url_filters.with_rules(df, RULES)
    m = np.zeros((len(hosts), len(hosts)))
    for i in range(len(names)):
        m[(i + 1) % len(names), i] = 1
    walk = lambda m, s: np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * np.eye(len(hosts))[s])
    trust, distrust = walk(m, 0), walk(m.T, len(names) - 1)
    got = {x.host: (x.trust, x.distrust) for x in url_filters.scores(judged).collect()}
    for i, host in enumerate(names):
        assert got[host] == pytest.approx((trust[i], distrust[i]), abs=url_filters.MARGIN / 2)
    want = {h: "block" if distrust[i] > trust[i] + url_filters.MARGIN else "allow" for i, h in enumerate(hosts)} | {"good.test": "allow", "bad.test": "block"}
    assert {x.host: x.verdict for x in url_filters.judge(df, RULES).collect()} == want
    assert want["h11.test"] != want["h12.test"] and want["other.test"] == "allow"


def test_links_in_every_form(spark):
    forms = ['<a href="//a.test/x">', "<a href='http://b.test'>", "<A HREF=https://C.test>", "<a Href = \"//d.test?q\">", "<a href=//e.test class=x>", "<a title='//f.test'>"]
    df = spark.createDataFrame([page(1, "home.test", *forms)], "page_id bigint, url string, html string")
    edges = {(x.src, x.dst) for x in url_filters.host_edges(url_filters.with_rules(df, RULES)).select("src", "dst").collect()}
    assert edges == {("home.test", f"{c}.test") for c in "abcde"}
