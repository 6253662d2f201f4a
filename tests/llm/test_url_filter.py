"""Listed rules against their definition, mined rules against a count of all combinations."""
from collections import Counter
from itertools import combinations

from scanloom.llm import url_filter as u

SCHEMA = "page_id long, url string, verdict string, token string, rule int, id string"


def table(spark, urls):
    return spark.createDataFrame([(i, url, "x", None, 1, "k") for i, url in enumerate(urls)], SCHEMA)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = next((i for i, c in enumerate(rest) if i >= cut and c in "?#"), len(rest))
    return host, rest[cut:end]


def listed(host, path):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in u.LISTED
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://EXAMPLE.com/en/x?y#z", "http://www.Example.COM/en/",
        "http://wwwexample.com/en/", "ftp://a.www.example.com/en/q", "x://net/es/", "x://a.net/fr/b", "http://net/de/", "://com/x",
        "http://a.com?x=/en/", "http://a.com#/", "https://a.org/en/1", "http://É.com/en/", "http://a.net/es", "http://b.com/x://y/z",
        "http://a.com/" + "seg/" * 3000, "http://a.com/x", "http://a.com/x"]


def test_listed_rules(spark):
    got = u.judge(table(spark, URLS), names=("host", "path", "listed", "said", "reason")).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path = split(URLS[row.page_id])
        rule = listed(host, path)
        assert (row.host, row.path, row.listed) == (host, path, rule and rule[0]), URLS[row.page_id]
        assert row.said == (rule[1] if rule else "allow") and (row.reason == "listed") == bool(rule)


def test_mined_rules_are_the_surest(spark):
    urls = ([f"http://a{i % 3}.com/shop/p{i}" for i in range(60)] + [f"http://a{i % 3}.net/es/spam/p{i}" for i in range(50)]
            + [f"https://b.net/fr/spam/x{i}?ref=1" for i in range(30)])
    asked = ["http://z.org/spam/q", "http://a1.org/shop/q", "https://b.org/q?ref=2", "http://q.org/w", "HTTPS://b.org/fr/x"]
    labelled = spark.createDataFrame([(x, listed(*split(x))[1]) for x in urls], "url string, verdict string")
    rows = labelled.select("url", "verdict", u.tokens_of(labelled.url).alias("own")).collect()
    rules = u.mine(labelled, 0.05, 0.9).collect()
    baskets, count = [(frozenset(r.own), r.verdict) for r in rows], Counter()
    for own, verdict in baskets:
        for n in range(1, len(own) + 1):
            for part in combinations(sorted(own), n):
                count[part, None] += 1
                count[part, verdict] += 1
    least = max(0.05 * len(rows), u.LEAST)
    want = {(part, v): count[part, v] / count[part, None] for part, v in count
            if v and count[part, v] >= least and count[part, v] / count[part, None] >= 0.9}
    useful = {k: s for k, s in want.items()
              if not any(v == k[1] and s2 >= s and set(p) < set(k[0]) for (p, v), s2 in want.items())}
    assert {(tuple(r.tokens), r.verdict): round(r.sure, 9) for r in rules} == {k: round(s, 9) for k, s in useful.items()}
    assert all(r.token == min(r.tokens, key=lambda t: (count[(t,), None], t)) for r in rules)
    got = {r.url: (r.said, r.reason) for r in u.judge(table(spark, urls + asked), support=0.05, names=("a", "b", "c", "said", "reason")).collect()}
    assert got["http://z.org/spam/q"] == ("block", "mined") and got["http://a1.org/shop/q"] == ("allow", "mined")
    assert got["http://q.org/w"][1] in ("mined", "default")


def test_empty(spark):
    assert u.judge(table(spark, []), names=("a", "b", "c", "d", "e")).count() == 0
