"""URL filter against plain Python rules and a plain sum of weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality.llm import url_filter
from txquality.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule(host, path):
    fitting = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else None


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/A?b#c", "https://example.com/en/1", "https://a.example.com/en/", "https://example.com/en",
    "ftp://x.net/es/q?://y", "http://net/fr/", "http://xnet/fr/", "http://com", "http://com/", "https://É.COM/é", "http://a.org?x/y", "http://a.org#/en/", "a://b://c.com/",
    "http://sub.www.example.com/en/x", "http://a.net/en/", "https://www.casino-bets.org/slots/win", "http://new\nline.com/en/\nx", "http://" + "a" * 50_000 + ".org/" + "b" * 50_000,
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, verdict string")
    out = url_filter.judge(pages)
    found = out.collect()
    assert len(found) == 2 * len(URLS) and len(set(out.columns)) == len(out.columns)
    for r in found:
        host, path = parts(r.url)
        expected = rule(host, path)
        assert (r.host, r.path) == (host, path), r.url
        assert r.rule == (expected[0] if expected else None) and r.verdict in ("allow", "block")
        if expected:
            assert r.verdict == expected[1]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_model_separates_its_table_and_scores_by_sum(spark):
    labelled = spark.createDataFrame(url_filter.SEED_URLS, "url string, label int")
    weights, intercept = url_filter.fit(labelled)
    rows = url_filter.with_parts(labelled).select("label", url_filter.gram_buckets().alias("g"), url_filter.probability(weights, intercept).alias("p")).collect()
    import math

    for r in rows:
        z = sum(weights[b] for b in r.g) / math.sqrt(len(r.g)) + intercept
        assert abs(1 / (1 + math.exp(-z)) - r.p) < 1e-9
    assert sum((r.p >= 0.5) == (r.label == 1) for r in rows) >= 0.95 * len(rows)


def test_other_labels(spark):
    empty = spark.createDataFrame([], "url string, label int")
    assert url_filter.fit(empty) == ([0.0] * url_filter.BUCKETS, 0.0)
    odd = spark.createDataFrame([(None, 1), ("http://a.org/x", None), ("http://bad.org/spam", 1), ("http://good.org/news", 0), ("x", 0)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://bad.org/spam"), (2, "http://good.org/news")], "page_id bigint, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, [], odd).collect()}
    assert found == {1: "block", 2: "allow"}


def test_query_is_native(spark, sf_dir):
    df = QUERIES["op9_url_filter"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
    assert df.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert df.where(F.col("rule").isNull()).count() > 0
