import random

from ledgerline.llm import queries
from ledgerline.llm import url_filters as U

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = None
    for v, r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return host, path, best and best[1], best and best[0]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = queries.QUERIES["op8_url_filters"](spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y=/z#q", "http://example.net/en", "https://net", "https://net/",
            "ftp://x.example.com/de/#", "http://notexample.com/de/", "http://example.com/de/a://b/", "x://a.org/fr/", "x://ORG/fr/é?q",
            "http://Ünï.org?x=/fr/", "http://h.org#/fr/", "http://a..net/x", "http://u:p@h.net:80/\n/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, "http://org/fr/"), (None, "http://q.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "'x' as host", "1 as n")
    out = spark.createDataFrame([(4, True), (4, None), (None, True)], "id long, bad boolean")
    got = U.judge(pages, out, U.rules_table(spark, RULES)).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == sorted(
        (str(i), *brute(u)[:2], str(brute(u)[2])) for i, u in rows)
    assert U.judge(pages.limit(0), out, U.rules_table(spark, RULES)).collect() == []
    assert U.judge(pages, out.limit(0), U.rules_table(spark, RULES)).count() == len(rows)


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for h, n, rate in [("bad.spam.org", 200, 0.95), ("good.fine.org", 200, 0.02), ("tiny.fine.org", 1, 1.0), ("new.spam.org", 3, None)]:
        for _ in range(n):
            i = len(rows)
            rows.append((i, f"http://{h}/de/{i}"))
            if rate is not None:
                labels.append((i, rng.random() < rate))
    got = {r.host: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"),
                                      spark.createDataFrame(labels, "id long, bad boolean"), U.rules_table(spark, RULES)).collect()}
    assert got["bad.spam.org"].verdict == "block" and got["good.fine.org"].verdict == "allow"
    assert got["tiny.fine.org"].verdict == "allow"                                   # one bad page is not enough
    assert got["new.spam.org"].bad_rate > got["tiny.fine.org"].bad_rate > got["good.fine.org"].bad_rate
