"""URL filters against brute force."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from creditloom.llm import url_filter

ODD = [
    None, "", "no scheme", "http://", "://", "http:///x", "http://Example.ORG", "http://EXAMPLE.org/ES/x", "http://example.org/es/", "http://a.b.example.org/es/1",
    "http://badexample.org/es/1", "http://example.org/en/1", "http://example.org/en/12?q#f", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9",
    "http://com/de/", "http://x.com/fr", "http://x.com?u=/de/", "http://x.com#/de/", "http://user:pw@x.net:80/a", "https://www.x.net./a/", "http://x.net//a",
    "http://x.net/a?b=2&a=1&utm_source=z", "http://x.net/a?a=1&&b=2&ref", "http://x.net/a?reference=1", "ftp://x.net/a://b", "http://ÄX.net/é", "http://x.net/a\nb?c\nd#e",
    "http://x.net/" + "p/" * 20000, "http://x.net/a?" + "&".join(f"k{i}={i}" for i in range(3000)),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def key(url):
    if url is None or "://" not in url:
        return None
    host, path = parts(url)
    host = host.rpartition("@")[2]
    host = re.sub(r":(80|443)$", "", host)
    host = host[:-1] if host.endswith(".") else host
    host = host[4:] if host.startswith("www.") else host
    path = re.sub("/+", "/", path)
    path = path[:-1] if path.endswith("/") else path
    rest = url.split("://", 1)[1].partition("#")[0]
    query = rest.partition("?")[2]
    kept = sorted(x for x in query.split("&") if x and not re.match(url_filter.TRACKING, x))
    return host + path + ("?" + "&".join(kept) if kept else "")


def verdict(url, rules, listed):
    host, path = parts(url)
    fits = []
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    if fits:
        return max(fits)[3:]
    return None, "block" if key(url) in listed else "allow"


def pages_of(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return df.withColumns({c: F.lit(c) for c in ("host", "key", "row", "block", "lane_0", "maybe", "listed", "verdict", "a.b")})


def urls_of(seed, n):
    rng = np.random.default_rng(seed)
    hosts = ["a.example.org", "x.com", "w.x.com", "q.net", "www.q.net", "Q.NET:443"]
    return [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(0, 30)}{rng.choice(['', '/', '#t', '?ref=x', '?p=1'])}" for _ in range(n)]


@pytest.mark.parametrize("blocks", [1, 1 << 20], ids=["saturated", "sized"])
def test_judged(spark, blocks):
    urls = ODD + urls_of(1, 400) + ["http://q.net/en/hot?ref=1"] * 300  # one URL holds a third of the rows
    listed = urls_of(2, 60) + ["http://q.net/en/hot", None, "nothing", "http://x.net/a"] + ODD[-2:]
    pages = pages_of(spark, urls)
    keys = spark.createDataFrame([(key(u),) for u in listed] * 2, "key string")
    out = url_filter.judged(pages, url_filter.RULES, keys, max_blocks=blocks)
    assert out.columns == [c for c in pages.columns if c not in ("host", "verdict")] + ["host", "path", "rule", "verdict"]
    block = {key(u) for u in listed} - {None}
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == [(i, *parts(u), *verdict(u, url_filter.RULES, block)) for i, u in enumerate(urls)]
    assert {r["a.b"] for r in out.collect()} == {"a.b"} and {r.key for r in out.collect()} == {"key"}


def test_rules(spark):
    rules = [("allow", "a.net/xyz"), ("block", "net/xyz.a"), ("block", "b.net/"), ("allow", "net/"), ("allow", "b.net/q"), ("block", "b.net/q")]
    urls = ["http://a.net/xyz.a", "http://b.net/", "http://b.net/q", "http://c.net/z", "http://net/", "http://b.net"]
    none = spark.createDataFrame([], "key string")
    out = url_filter.judged(pages_of(spark, urls), rules, none).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in out] == [verdict(u, rules, set()) for u in urls]
    with pytest.raises(ValueError):
        url_filter.ordered_rules([("allow", f"h{i}/") for i in range(url_filter.MAX_RULES + 1)])
    with pytest.raises(ValueError):
        url_filter.ordered_rules([("deny", "h/")])


def test_filter_passes_every_listed_key_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(40000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    out = url_filter.possible_hits(rows, keys)
    got = {r.other: r.n for r in out.where("maybe").groupBy((F.col("id") >= 20000).alias("other")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[False] == 20000 and 0 < got[True] < 200  # eight of sixteen bits a key, in blocks: below one in a hundred


@pytest.mark.parametrize("n", [0, 1])
def test_query_and_sql(spark, tmp_path, n):
    marks = " ".join(["***"] * 20)
    rows = [(i, u, marks if i % 9 == 0 else "plain") for i, u in enumerate(urls_of(5, 300))] + [(900 + i, u, None) for i, u in enumerate(ODD)] + [(3, "http://q.net/en/1", marks)] * 2
    df = spark.createDataFrame(rows * n, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(url_filter.op11_url_filter(spark, str(tmp_path)), con.execute(url_filter.SQL)) == ""
    assert n == 0 or {r.verdict for r in url_filter.op11_url_filter(spark, str(tmp_path)).where("rule is null").collect()} == {"allow", "block"}
