"""Top-k search, mixing and URL rules against SQL or brute force, and their edges."""

import re

import numpy as np
import pytest

from dossier.llm import mixing, queries, topk, url_rules
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_search_prunes_nothing_that_counts(monkeypatch):
    rng = np.random.default_rng(0)
    for dims, high in ((64, 300), (7, 3), (1, 2)):
        c = rng.integers(-high, high, (500, dims)).astype(float)
        c[::7] = c[0]
        ids = rng.permutation(500)
        for chunk, dense in ((64, 0.05), (500, 2.0), (100, -1.0)):
            monkeypatch.setattr(topk, "CHUNK", chunk)
            monkeypatch.setattr(topk, "DENSE", dense)
            best = [sorted(((-float(c[i] @ c[j]), ids[j]) for j in range(500) if ids[j] != ids[i]))[:5] for i in range(20)]
            for least in (None, np.array([-b[-1][0] for b in best])):
                q, v, s = topk.search(c[:20], c, ids[:20], ids, ids, 5, least)
                for i in range(20):
                    assert [(-x, n) for x, n in zip(s[q == ids[i]], v[q == ids[i]], strict=True)] == best[i]


def brute_top_k(rows, k=5):
    """Each query row's k best others, in Python's integers."""
    from fractions import Fraction
    from math import floor

    ok = [(i, [floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % 50 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(p * r for p, r in zip(x, y)))), i) for b, (i, y) in enumerate(ok) if b != a and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("candidates", [3, 4096])
def test_top_k_edges(spark, monkeypatch, candidates):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (50, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [9.0, 9.0]), (100, [1.0]), (-50, [0.001, -0.001]), (6, []), (50, [0.5, 0.5])]
    rows += [(7, [1e300, -1e300]), (8, [3e15, 1.25]), (150, [1e308, 0.1]), (200, [2.0**40 + 0.5, -3.0]), (9, [-(2.0**41), 7.0])] + [(int(i), rng.normal(size=2).tolist()) for i in rng.integers(0, 120, 60)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)).collect()))
    assert got == brute_top_k(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        off = abs(sum(r["size"] * r["copies"] for r in v) - v[0]["target"])
        assert off < max(0.05 * v[0]["target"], 0.25 * max(r["size"] for r in v)) and all(0 <= r["copies"] <= 3 for r in v)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))


def test_mix_edges(spark):
    rows = [(1, "a b c d", "b", 0), (2, "a b", "a", 0), (2, "a b", "a", 0), (3, None, "a", 0), (4, "", None, 0), (5, "x " * 50_000, None, 0), (None, "q", "\U0001f600", 0), (6, None, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mixed(docs).collect()
    assert len(got) == 8 and {r["size"] for r in got if r["doc_id"] in (3, 4, 6)} == {0}
    assert all(r["target"] <= 3 * r["source_size"] for r in got) and abs(sum({r["source"]: r["target"] for r in got}.values()) - 50_009) < 1e-6
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.where("doc_id = 2").count() % 2 == 0
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0


def test_rules_nest_and_the_longest_wins(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x/", "block"), ("example.net", "/en/", "allow"), ("", "/", "block"), (None, None, None)]
    urls = {"http://net/": "net/", "https://EXAMPLE.net/en/1": "example.net/en/", "http://b.a.example.net/en/x/1?q": "a.example.net/en/x/", "http://notexample.net/en/": "net/", "http://net": None, "http://example.network/en/": None, "nothing": None, None: None, "http://x.net/en/#a://b": "net/", "http:///p": "/"}
    frame = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["url"]: r for r in url_rules.judged(frame.repartition(3), table, points=3).collect()}
    assert {u: r["rule"] for u, r in got.items() if u not in ("nothing", None)} == {u: r for u, r in urls.items() if u not in ("nothing", None)}
    assert {r["key"] for r in got.values()} == {"own"} and got["http://net"]["verdict"] == "allow" and got["http://net/"]["verdict"] == "block"
    assert url_rules.judged(frame.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judged(frame, table.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("run", [3, 4096])
def test_many_rules_equal_a_plain_search(spark, run):
    rng = np.random.default_rng(run)
    label = lambda: "abé\U0010ffff"[rng.integers(0, 4)]
    hosts = lambda: ".".join(label() for _ in range(rng.integers(1, 4)))
    paths = lambda: "/" + "".join("ab/"[rng.integers(0, 3)] for _ in range(rng.integers(0, 5)))
    rules = {(hosts(), paths() if rng.random() < 0.7 else ""): ("block", "allow")[rng.integers(0, 2)] for _ in range(120)}
    urls = [f"http://{hosts()}{paths()}?q" for _ in range(300)] + [f"ftp://{hosts()}/" + "a" * 100_000] + ["http://a/"] * 50 + ["http://" + "a." * 3000 + "b/a"]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    got = {r["id"]: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "id long, url string").repartition(3), table, run=run, points=40).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = got[k]["host"], got[k]["path"]
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[k]["rule"], got[k]["verdict"]) == (max(fits)[3:] if fits else (None, "allow")), u[:80]


def plain_rule(url, rules):
    """The longest rule that fits a url, by a search over all of them."""
    rest = url[url.index("://") + 3 :] if "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for (h, p), v in rules.items() if (host == h or (h and host.endswith("." + h))) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, "allow"))


@pytest.mark.parametrize("seed", [0, 1])
def test_control_characters_are_characters_of_a_label(spark, seed):
    rng = np.random.default_rng(seed)
    part = lambda letters, least, most: "".join(rng.choice(list(letters), rng.integers(least, most)))
    host = lambda: ".".join(part("ac\x00\x01\x02", 0, 3) for _ in range(rng.integers(1, 4)))
    path = lambda: "/" + part("a/\x00\x01\x02\xff", 0, 4)
    rules = {("example.com", "/de/"): "block", ("example.net", "/en/"): "allow", ("net", "/"): "block"} | {(host(), path()): ("block", "allow")[rng.integers(0, 2)] for _ in range(80)}
    urls = ["http://com\x01example/de/x", "http://net\x01example/en/x", "http://com\x02b.example/de/"] + [f"http://{host()}{path()}" for _ in range(400)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    for run in (3, 4096):
        got = {r["id"]: r for r in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "id long, url string").repartition(3), table, run=run).collect()}
        assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == [plain_rule(u, rules) for u in urls]
