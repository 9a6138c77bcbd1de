import re

import pytest
from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import urlfilter as U

URLS = ["http://a.net/x", "https://Example.NET/en/1", "http://www.example.net/en/", "http://example.net/en", "http://x.example.com/de/y?q#f",
        "http://x.org/fr/1", "http://x.org/en/", "http://net/", "http://net", "http://badnet/", "http://a.net?x=/", "no scheme", "", None,
        "http://a.net:80/x", "http:///path", "x://y://net/", "http://a.net./x", "http://ex\u00c9.net/\u00e9", "http://a.net/x", "ftp://a..net//en/",
        "http://" + "a." * 3000 + "example.net/en/x", "http://.net/", "http://./", "http://deep.b.c.org/fr/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [U.CONTRACT_RULES, (("net", "", "block"), ("a.net", "/x", "allow"), ("org", "/fr", "block"), ("COM", "/de/y", "block")),
                                   (("b.c.org", "/fr", "block"), ("example.net", "/", "allow"))])
def test_verdicts_equal_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "v", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "v", "r")],
                                  "page_id long, url string, host string, verdict string, rule string")
    got = U.judge(pages, spark.createDataFrame(list(rules), "host string, path string, verdict string")).collect()
    low = [(h.lower(), p, v) for h, p, v in rules]
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[0] if r["page_id"] is None else URLS[r["page_id"]]
        assert tuple(r)[1:] == brute(url, low), url


def test_block_wins_between_equal_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert U.judge(pages, rules).first()["verdict"] == "block"
    assert U.judge(pages, rules.limit(0)).first()["rule"] is None
    assert U.judge(pages.limit(0), rules).count() == 0
