import random

import pytest

from deskflume.llm import url_filter

VALUES = ["block", "allow"]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and v and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, v == "block", v))
    return host, path, best and best[2], best[4] if best else default


def cases():
    random.seed(5)
    hosts = ["net", "a.net", "b.a.net", "org", "x.org", "net.org", "xnet", "é.net", "a.net:80", "", "a..net", ".net", "A.NET"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/english", "/de/1/2/3", "/é/漢", "/x" * 4000]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#/x", "?a#b")]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "mailto:x@a.net", "http://a.net/en/\nline/x", "//a.net/en/"]
    rules = [(h, p, random.choice(VALUES)) for h in ("net", "a.net", "org", "x.org", "b.a.net", "Net.org") for p in ("/", "/en/", "/en", "", "/de/1/") if random.random() < 0.6]
    return urls, rules + [("a.net", "/en/", "allow"), ("a.net", "/en/", "block"), ("", "/", "block"), (None, "/", "block"), ("org", None, "allow"), ("org", "/x", None)]


@pytest.mark.parametrize("small", [url_filter.SMALL, -1])
def test_verdicts_against_plain_rules(spark, monkeypatch, small):
    """Both ways of meeting: broadcast under a checked size, and shuffled with frequent keys apart."""
    monkeypatch.setattr(url_filter, "SMALL", small)
    urls, rules = cases()
    rows = [(k, u, "own", "h") for k, u in enumerate(urls)] + [(None, "http://b.a.net/en/x", "own", "h")] * 300
    pages = spark.createDataFrame(rows, "page_id long, url string, url_verdict string, uf_host string").repartition(5)
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == [*pages.columns, "url_verdict_"]
    seen = got.collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert tuple(r.url_verdict_) == plain(r.url, rules) and r.url_verdict == "own", r.url


@pytest.mark.parametrize("small", [url_filter.SMALL, -1])
def test_empty_tables(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "SMALL", small)
    pages, rules = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert [tuple(r.url_verdict) for r in url_filter.judge(pages, rules.where("false"), default="block").collect()] == [("a.net", "/", None, "block")]


def test_query_is_the_plain_rule(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in url_filter.op12(spark, sf).collect())
    assert got == sorted((r.page_id, *plain(r.url, url_filter.RULES)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
