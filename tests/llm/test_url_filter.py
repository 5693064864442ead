"""Hosts, paths and rules against plain Python; the classifier on held-out urls."""

import re

from frauddeck.llm import url_filter as U

URLS = [None, "", "example.com/en/", "http://", "HTTP://WWW.Example.COM/en/X?y#z", "http://example.com", "http://a.example.com/en/1", "http://www.example.com/en", "http://www.example.com/en/", "x://y://net/es/",
        "http://net/es/", "https://a.net/fr/q", "http://anet/es/", "http://example.com?/en/", "http://example.com#/en/", "http://É.com/en/", "//com/", "http://com/\nfoo", "\nhttp://com/a", "http://notexample.com/en/", "h://" + "a" * 5000 + ".org/"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def check(rows, urls):
    for r in rows:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_cases(spark):
    model = U.fit(U.labelled_urls(spark))
    df = spark.createDataFrame([(i, u, "x", 2) for i, u in enumerate(URLS)], "page_id long, url string, host string, features int")
    got = U.judge(df, model).collect()
    assert len(got) == len(URLS)
    check(got, dict(enumerate(URLS)))
    again = U.judge(spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string"), model, rules=[])
    assert {(r["rule"], r["verdict"]) for r in again.collect()} == {(None, "allow")} and again.count() == 3
    assert U.judge(df.where("false"), model).count() == 0


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    urls = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op9_url_filters"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    check(got, urls)


def test_model_on_urls_left_out(spark):
    rows = [(u, 1) for u in U.BLOCKED] + [(u, 0) for u in U.ALLOWED]
    right = 0
    for k in range(4):
        train = spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 != k], "url string, label int")
        test = spark.createDataFrame([(r[1], r[0]) for i, r in enumerate(rows) if i % 4 == k], "page_id long, url string")
        right += sum((r["verdict"] == "block") == bool(r["page_id"]) for r in U.judge(test, U.fit(train), rules=[]).collect())
    assert right >= 0.7 * len(rows)
