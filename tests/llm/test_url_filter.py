"""URL rules and terms against a plain search."""

import re

from cadenza.llm import url_filter
from cadenza.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/en/", "http://", "http://EXAMPLE.net", "http://example.net/", "https://a.EXAMPLE.net/en/x?y#z",
    "https://a.example.net/EN/x", "http://myexample.net/en/x", "http://example.com/de/1", "http://b.example.com/fr/de/",
    "http://x.org/fr/?a", "http://org/fr/", "http://x.org/de/", "ftp://u:p@host.com:80/a/b#c", "http://q.com?xxx",
    "http://q.com/SEX-free", "http://sussex.com/", "http://ads-track.example.com/es/", "http://ads.ads.com/ads",
    "http://free.com/\u00e9porn\u00e9", "a://b://c/d", "http://m.com/deal/win/bonus", "http://x.com/" + "a/" * 20_000 + "xxx",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hard, weak = (
        sum(bool(re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in terms) for terms in (url_filter.STRICT, url_filter.SOFT)
    )
    verdict = rule.verdict if rule else "block" if hard or weak >= 2 else "allow"
    return host, path, rule and rule.name, verdict, hard, weak, 1.0 if hard else min(1.0, weak / 2)


def test_against_plain_search(spark):
    urls = URLS + URLS[:8]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, found int")
    got = {r[0]: tuple(r[1:]) for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_empty(spark):
    df = url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES)
    assert df.columns == ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "score"]
    assert df.collect() == []


def test_vocabulary_from_a_table(spark):
    rows = [
        ("XXX", "strict", None), ("deal", "soft", 0.5), ("Deal", "soft", 0.25), ("win", "soft", 1.5), ("bonus", "soft", None),
        ("both", "soft", 3.0), ("both", "strict", 1.0), ("odd", "other", 1.0), (None, "soft", 1.0), ("", "strict", 1.0),
    ]
    terms = spark.createDataFrame(rows, "term string, kind string, weight double")
    strict, soft = url_filter.vocabulary_of(terms)
    assert (strict, soft) == (("both", "xxx"), {"bonus": 1.0, "deal": 0.5, "win": 1.5})
    urls = ["http://a/xxx", "http://a/BOTH", "http://a/deal-bonus", "http://a/win-deal", "http://a/win", "http://a/win-win", "http://a/odd"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["verdict"], r["score"]) for r in url_filter.judge_urls(pages, [], strict, soft).orderBy("page_id").collect()]
    assert got == [("block", 1.0), ("block", 1.0), ("allow", 0.75), ("block", 1.0), ("allow", 0.75), ("allow", 0.75), ("allow", 0.0)]
    assert url_filter.vocabulary_of(terms.limit(0)) == ((), {})
    empty = url_filter.judge_urls(pages, [], (), ()).collect()
    assert {r["verdict"] for r in empty} == {"allow"}
