import re

from millrace.llm import url_filter as x
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return lower(host), re.split(r"[?#]", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(len(h + p), a == "allow", a, h + p) for a, h, p in x.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def got(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


URLS = ["http://Example.ORG/es/1", "https://a.example.org/en/123?x=://y", "http://example.org", "http://org/x", "ftp://myexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a#b", "HTTP://x.COM?q", "noscheme/x", "", None, "://", "a://b://c/d", "http://x.net/de/", "http://example.org/en/2", "http://com/de/", "http://É.com/de/É", "http://x.com\n/de/"]


def test_rules_equal_brute_force(spark):
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], SCHEMA)
    for i, (host, path, rule, verdict) in got(x.verdicts(d)).items():
        b = brute_rule(*parts(URLS[i]))
        assert ((host, path), rule, verdict) == (parts(URLS[i]), b and b[1], b[0] if b else "allow"), URLS[i]


def link(u):
    return f'<html><head><LINK href="{u}" rel="canonical"></head>'


def test_aliases(spark):
    rows = [
        (1, "http://a.net/1", link("http://x.com/de/bad")),  # its canonical URL is blocked
        (2, "http://a.net/2", '<meta http-equiv="Refresh" content="0; URL=/1">'),  # by way of page 1
        (3, "https://a.net/2#top", None),  # the same resource as page 2
        (4, "http://b.net/", link("http://x.com/fr/ok")),
        (5, "http://c.net/p/q", "<link rel=canonical href=r>"),  # http://c.net/p/r, allowed: it also leads to a blocked URL
        (6, "http://c.net/p/r", link("http://x.com/de/c")),
        (7, "http://lone.net/", "<p>canonical refresh</p>"),
        (8, "http://x.com/fr/own", link("http://x.com/de/bad")),  # its own rule decides, and allows its aliases
        (9, "http://d.net/", '<link rel="stylesheet" href="http://x.com/de/s.css">'),
        (10, None, link("http://x.com/de/bad")),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    want = {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    assert {i: v[3] for i, v in got(x.verdicts(d)).items()} == want
    want |= {1: "block", 2: "block", 3: "block"}
    assert {i: v[3] for i, v in got(x.verdicts(d.filter("page_id <> 8"))).items()} == {i: v for i, v in want.items() if i != 8}
    more = spark.createDataFrame([("http://lone.net", "http://c.net/p/q"), (None, "http://x"), ("http://lone.net", "http://lone.net/")], "src string, dst string")
    assert got(x.verdicts(d, more))[7][3] == "block"


def test_hub_and_edges(spark):
    rows = [(i, f"http://n{i}.net/", link("http://hub.net/")) for i in range(300)] + [(1000, "http://hub.net", link("http://x.com/de/"))] * 2
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("host", "NODE", "r", "verdict", "said"):
        d = d.withColumn(c, F.lit(1))
    out = x.verdicts(d)
    assert out.count() == 302 and {r.verdict for r in out.collect()} == {"block"}
    assert x.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dot_segments(spark):
    from urllib.parse import urljoin

    base = "http://h.net/a/b/c/page.html?x=/../"
    targets = ["../up", "../../up2/./x", "./same", "../../../../../over", "/r/../s/./t/..", "d/..", "q?y=../z", "plain", "http://o.net/p/../q", "//n.net/./m"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(targets)), "i int, t string").orderBy("i").select(x._resolve(F.col("t"), F.lit(base))).collect()]
    assert got == [urljoin(base, t) if "://" not in t and not t.startswith("//") else {"http://o.net/p/../q": "http://o.net/q", "//n.net/./m": "http://n.net/m"}[t] for t in targets]


def test_long_pages_and_equal_rules(spark):
    long = "http://x.com/" + "a/" * 100_000
    rows = [(1, long, link("http://x.com/de/bad") + "<p>" * 300_000), (2, "http://y.net/" + "b" * 200_000, link("http://x.com/de/bad"))]
    assert {i: v[3] for i, v in got(x.verdicts(spark.createDataFrame(rows, SCHEMA))).items()} == {1: "block", 2: "block"}
    rules = (("block", "t.org", "/abc"), ("allow", "t.org", "/abc"), ("block", "t.org", "/xy"))
    d = spark.createDataFrame([(1, "http://t.org/abcd", None), (2, "http://t.org/xyz", None)], SCHEMA)
    assert {i: v[2:] for i, v in got(x.verdicts(d, rules=rules)).items()} == {1: ("t.org/abc", "allow"), 2: ("t.org/xy", "block")}


def test_ten_thousand_rules(spark):
    """Joined rules against each rule tried on each page, and against compiled ones; long and odd hosts, rules of equal length."""
    import random

    rng = random.Random(5)
    names = ["a", "b", "cc", "example", "news", "x1", ""]
    host = lambda: ".".join(rng.choices(names, k=rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choices("ab/é", k=rng.randrange(0, 6)))
    rules = sorted({(rng.choice(["allow", "block"]), host(), path()) for _ in range(10_000)} | {("block", "net", "")})
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=1', '#x'])}" for _ in range(300)] + [None, "no scheme", "http://", "http://" + "a." * 5000 + "cc/ab", "http://news.example/" + "ab" * 5000]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in x.verdicts(pages, rules=rules).collect()}
    table = {r.page_id: r for r in x.verdicts(pages, rules=spark.createDataFrame([*rules, (None, None, "/"), ("allow", "q", None)], "action string, host string, path string")).collect()}
    assert len(got) == len(urls) and got == table
    for r in got.values():
        fits = [(len(h + p), a == "allow", h + p) for a, h, p in rules if (r.host == h or r.host.endswith(f".{h}")) and r.path.startswith(p)]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[2], "allow" if best[1] else "block") if best else (None, "allow")), r
    some = rules[::25]
    assert len(some) <= x.MOST_RULES
    compiled, was = x.verdicts(pages, rules=some).collect(), x.MOST_RULES
    try:
        x.MOST_RULES = 0
        assert sorted(map(tuple, x.verdicts(pages, rules=some).collect())) == sorted(map(tuple, compiled))
    finally:
        x.MOST_RULES = was
