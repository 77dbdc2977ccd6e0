import itertools

from maskloom.llm import url_rules as u


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "x", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://www.example.com/en/1?q#f", "https://sub.www.example.com/en/", "http://example.com/en/", "http://myexample.com/en/", "http://a.example.net/es/9", "http://a.example.net/de/9#x", "http://net?x=/es/", "a://b://com/", "http://u@x.net/fr/", "http://..com/", "http://x.com./a", "http://\nx.com/\n/a", "http://" + "a." * 60 + "net/fr/" + "z" * 5000]


def test_matches_brute_force_with_hot_host_and_other_rules(spark):
    urls = URLS * 3 + ["http://hot.example.com/en/%d" % (i % 50) for i in range(900)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [(h, p, v) for (h, v), p in itertools.product([("com", "a"), ("x.com", "b"), ("example.net", "c"), ("", "d")], ["/", "/e", "/en/", "", "/es/9"])]
    for rules in (u.RULES, more):
        got = u.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert u.judge(pages, rules).collect()[0].verdict == "allow"
    assert u.judge(pages.limit(0), rules).count() == 0
