import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filters as op
from tests.llm.conftest import MIDDLE, read


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules=op.RULES):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pagerank(edges, seeds, damping=op.DAMPING):
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[at[b], at[a]] = 1 / sum(1 for x, _ in edges if x == a)
    base = np.array([seeds.get(h, 0.0) for h in hosts])
    score = (1 - damping) * np.linalg.solve(np.eye(len(hosts)) - damping * m, base)
    return dict(zip(hosts, score, strict=True))


PAGES = [
    (1, "http://good.org/a", '<a href="http://x.net/1">x</a> <a href="//y.net/">y</a><a href="/own">o</a>'),
    (2, "https://x.net/p?q=1", '<a HREF=\'https://Z.net:80/q\'>z</a><a href="http://x.net/2">self</a>'),
    (3, "http://bad.com/de/1", ""), (4, "http://w.net/", '<a href="http://bad.com/x">b</a>' * 3), (5, "http://v.net", '<a href="http://w.net/">w</a>'),
    (6, "http://sub.w.net/a#f", None), (7, None, "<a href='http://x.net'>"), (8, "no scheme/path", "x"), (9, "", None), (None, "http://good.org/a", "y"),
    (10, "HTTP://A.Example.ORG/es/1", ""), (11, "http://example.org/en/12?x", ""), (12, "http://example.org/en/2", ""), (13, "x://fr.com/fr/y\nz", ""),
    (13, "x://fr.com/fr/y\nz", ""), (14, "http://notexample.org", ""), (15, "a://?://b.com/de/", ""),
]


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, host int, ruled int")
    return pages, op.judge_urls(pages).collect()


def test_rules_and_parts(judged):
    _, rows = judged
    want = [(i, *parts(u), rule_of(*parts(u))[0]) for i, u, _ in PAGES]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        if r.rule:
            assert r.verdict == rule_of(r.host, r.path)[1]


def test_hosts_follow_propagation(judged):
    pages, rows = judged
    links = [("good.org", "x.net"), ("good.org", "y.net"), ("x.net", "z.net:80"), ("w.net", "bad.com"), ("v.net", "w.net"),
             ("sub.w.net", "w.net"), ("w.net", "sub.w.net"), ("a.example.org", "example.org"), ("example.org", "a.example.org")]
    host, _ = op.url_parts(F.col("url"))
    assert sorted(tuple(e) for e in op.host_edges(pages.withColumn("host", host)).collect()) == sorted(links)
    ruled = [(parts(u)[0], rule_of(*parts(u))[1]) for _, u, _ in PAGES if parts(u)[0]]
    seeds = lambda v: {h: sum(1 for x in ruled if x == (h, v)) / sum(1 for x in ruled if x[1] == v) for h, w in ruled if w == v}
    trust, distrust = pagerank(links, seeds("allow")), pagerank([(b, a) for a, b in links], seeds("block"))
    hosts = {h for h, _ in ruled}
    for r in rows:
        t, d = trust.get(r.host, 0.0), distrust.get(r.host, 0.0)
        if r.host:
            assert abs(r.trust - t) < 1e-5 and abs(r.distrust - d) < 1e-5
        if not r.rule:
            bad = r.host and d >= op.RATIO * t and d >= op.LEAST / len(hosts)
            assert r.verdict == ("block" if bad else "allow")
    by = {r.host: r.verdict for r in rows if not r.rule}
    assert by["w.net"] == "block" and by["x.net"] == "allow" and by[""] == "allow"


def test_rules_are_the_contracts(spark):
    assert [(v, h + p) for h, p, v in op.RULES] == [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = {"http://a.org/x": "allow", "http://example.org/es/1": "block", "http://w.example.org/en/12?x": "block", "http://example.org/en/2": "allow",
            "http://b.com/fr/": "allow", "http://b.com/de/2#f": "block"}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {list(urls)[r.page_id]: r.verdict for r in op.judge_urls(pages).collect()} == urls


def test_whole_table(spark):
    from tessera.llm.queries import QUERIES

    got = sorted((r.page_id, r.host, r.path, r.rule) for r in QUERIES["op2_url_filters"](spark, MIDDLE).select("page_id", "host", "path", "rule").na.fill("-", ["rule"]).collect())
    assert got == sorted((p[0], *parts(p[1]), rule_of(*parts(p[1]))[0] or "-") for p in read(MIDDLE, "pages"))


def test_empty_table(judged):
    assert op.judge_urls(judged[0].limit(0)).count() == 0
