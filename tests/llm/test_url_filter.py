import re

from vellum.llm.url_filter import RULES, filter_urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.Example.COM/en/7?x=/en/", "http://example.com/en/714", "http://example.com/en/6", "http://example.company/en/7",
    "http://xexample.com/en/7", "https://a.b.example.net/de/8#t", "https://net/de/", "https://net/de", "ftp://other.net/de/81", "http://example.net/de/81", "x://y://org/es/",
    "http://a.org/es/?q", "http://a.org:80/es/", "http://a.org?u=/es/", "http://a.org/es\n/", "http://.org/es/", "http://ÉX.org/es/é", "http://a..com/en/",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fitting = [(h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fitting, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_equals_brute_force(spark):
    rows = [(i, u, "extra") for i, u in enumerate(URLS)] + [(4, URLS[4], "extra"), (None, URLS[5], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").selectExpr("*", "'x' as prefix", "'y' as action")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = filter_urls(pages, rules).collect()
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url) for r in got)
    assert {r.verdict for r in got} == {"allow", "block"}
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_equal_rules_block_and_null_rules_drop(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/", "block"), (None, "/", "block"), ("c", "/", None)], "host string, path string, action string")
    pages = spark.createDataFrame([("http://x.a.b/",), ("http://c/",)], "url string")
    assert [(r.rule, r.verdict) for r in filter_urls(pages, rules).orderBy("url").collect()] == [(None, "allow"), ("a.b/", "block")]
