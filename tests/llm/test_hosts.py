import re

import numpy as np
import pytest

from tessera.llm import hosts

SCHEMA = "page_id long, url string, html string, host int, rule string"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "https://a.example.net/de/", "ftp://net", "http://net/", "http://example.net?/en/", "http://www.example.org/fr/1", "x://org/fr", "http://b.example.com/de/9://c/", "http://É.com/", "http://notexample.com/de/"]
    rows = [(i, u, None, 1, "own") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in hosts.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, u in enumerate(urls):
        host, path = plain(u)
        fits = [r for r in hosts.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == hosts.RULES[rule]
    assert got[0].verdict == "allow"


def test_empty_table(spark):
    assert hosts.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def solved(m, seed):
    """Ranks by a matrix equation: walks that end at a host without links begin anew at the seeds."""
    n = len(seed)
    p = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    p[m.sum(1) == 0] = seed
    return np.linalg.solve(np.eye(n) - hosts.DAMPING * p.T, (1 - hosts.DAMPING) * seed)


@pytest.mark.parametrize("hot", [1024, 2])
def test_ranks_equal_a_matrix_equation(spark, hot, monkeypatch):
    monkeypatch.setattr(hosts, "HOT", hot)
    rng = np.random.default_rng(1)
    n = 12
    m = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(m, 0)
    m[5] = 0
    edges = [("allow", f"h{i}", f"h{j}", float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
    seed = np.zeros(n)
    seed[[0, 3]] = 0.25, 0.75
    got = hosts.spread(spark.createDataFrame(edges, "kind string, src string, dst string, w double"), spark.createDataFrame([("allow", "h0", 0.25), ("allow", "h3", 0.75)], "kind string, host string, seed double"))
    found, rank = {r.host: r["rank"] for r in got.collect()}, solved(m.astype(float), seed)
    assert all(abs(found.get(f"h{i}", 0) - rank[i]) < 2 * hosts.CLOSE for i in range(n)) and abs(sum(found.values()) - 1) < 1e-9


def test_verdicts_of_a_graph_of_hundreds_of_hosts(spark):
    """Hosts in good and bad clusters that link mostly among themselves, and a hub that all link to: verdicts against the matrix equation."""
    rng = np.random.default_rng(2)
    n = 240
    name = lambda i: f"good{i}.org" if i == 0 else f"bad{i}.net" if i == 1 else f"host{i}.test"
    m, pages = np.zeros((n, n)), []
    for i in range(n):
        to = [j for j in rng.integers(0, n // 2, 5) * 2 + (i % 2 if rng.random() < 0.9 else 1 - i % 2) if j != i] + ([7] if i != 7 else [])
        for j in to:
            m[i, j] += 1
        pages.append((i, f"https://{name(i)}{'/fr/' if i == 0 else '/'}p", " ".join(f'<a href="http://{name(j)}/x">' for j in to), 0, ""))
    got = {r.page_id: r for r in hosts.judged(spark.createDataFrame(pages, SCHEMA)).collect()}
    trust, distrust = solved(m, np.eye(n)[0]), solved(m.T, np.eye(n)[1])
    sure = 0
    for i in range(2, n):
        assert abs(got[i].trust - trust[i]) < 2 * hosts.CLOSE and abs(got[i].distrust - distrust[i]) < 2 * hosts.CLOSE
        if abs(distrust[i] - trust[i]) > 4 * hosts.CLOSE:
            sure += 1
            assert got[i].verdict == ("block" if distrust[i] > trust[i] else "allow")
    assert sure > 20 and {r.verdict for r in got.values()} == {"allow", "block"}


def test_repeated_pages_and_a_page_of_many_links(spark):
    html = " ".join(f'<a href="http://h{i % 500}.test/{i}">' for i in range(20_000))
    rows = [(1, "http://a.net/", html, 0, "")] * 2 + [(1, "http://a.test/", "x" * 500_000, 0, ""), (None, "http://h3.test/", None, 0, "")]
    got = hosts.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and [r.verdict for r in got if r.host == "a.net"] == ["block"] * 2 and [r.verdict for r in got if r.page_id is None] == ["allow"]


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [
        (1, "http://bad.example.com/de/a", "", 0, ""),
        (2, "http://friend.test/", '<a HREF="http://bad.example.com/x">', 0, ""),
        (3, "http://good.org/fr/a", "<img src='//liked.test:80/i'>", 0, ""),
        (4, "http://liked.test:80/", '<a href="/own">', 0, ""),
        (5, "http://alone.test/", None, 0, ""),
    ]
    got = {r.page_id: r.verdict for r in hosts.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
