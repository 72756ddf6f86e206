from __future__ import annotations

from datetime import datetime

from corpuskit.llm import url_lists as ul

D = lambda d: datetime(2024, 1, d)


def entries(spark, rows):
    return spark.createDataFrame(rows, "list_name string, pattern string, entry_date timestamp, action string")


def covers(pattern, url):
    """Brute force: whether a pattern covers a URL."""
    rest = url.lower().split("//", 1)[1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.rsplit("@")[-1].split(":")[0].removeprefix("www.").rstrip(".")
    domain, _, tail = pattern.partition("/")
    parts, want = [x for x in path.split("/") if x], [x for x in tail.split("/") if x]
    return (host == domain or host.endswith("." + domain)) and parts[: len(want)] == want


def test_intervals(spark):
    log = [("l", "A.com.", D(1), "add"), ("l", "a.com", D(1), "add"), ("l", "http://www.a.com/", D(5), "remove"), ("l", "a.com", D(9), "ADD"), ("l", "a.com", D(10), "add"),
           ("l", "b.com", D(3), "remove"), ("l", "c.com", D(3), "add"), ("l", "c.com", D(3), "remove"), ("l", None, D(3), "add"), ("l", " ", D(3), "add"), ("l", "d.com", None, "add"), ("l", "d.com", D(1), "x")]
    got = sorted(tuple(r) for r in ul.intervals(entries(spark, log)).collect())
    assert got == [("l", "a.com", D(1), D(5)), ("l", "a.com", D(9), None)]


def test_every_capture_is_held_against_what_was_active_then(spark):
    log = [("l", "a.com", D(2), "add"), ("l", "a.com", D(4), "remove"), ("m", "x.a.com/p/q", D(3), "add"), ("m", "com", D(20), "add"), ("k", "a.com", D(3), "add"), ("k", "a.com", D(6), "remove")]
    urls = ["http://a.com", "https://u@www.A.com:80/p/q/r?s#t", "http://x.a.com/p/q", "http://x.a.com/p/qq", "//xa.com/", "http://b.org/a.com", "ftp://y.x.a.com./p//q/"]
    rows = [(i * 30 + d, u, D(d)) for i, u in enumerate(urls) for d in range(1, 25)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp")
    got = {r.page_id: r for r in ul.evaluate(df, entries(spark, log)).collect()}
    spans = [(r.list_name, r.pattern, r.valid_from, r.valid_to) for r in ul.intervals(entries(spark, log)).collect()]
    for i, u, t in rows:
        hits = sorted((-len(p), p, n) for n, p, a, b in spans if covers(p, u) and a <= t and (b is None or t < b))
        r = got[i]
        assert (r.blocked, r.active) == (bool(hits), len(hits)), (u, t, r, hits)
        if hits:
            assert (r.pattern, r.list_name) == hits[0][1:]
    assert len(got) == len(rows) and {r.blocked for r in got.values()} == {True, False}


def test_patterns_of_any_depth(spark):
    log = [("l", "a.com/1/2/3/4", D(1), "add"), ("l", "b.org/" + "x/" * 40, D(1), "add"), ("l", "a.com/1/2/3/4/5/6", D(1), "add")]
    urls = ["http://a.com/1/2/3/4", "http://www.a.com/1/2/3/4/5?q", "http://s.a.com/1/2/3/4/5/6/7", "http://a.com/1/2/3/40", "http://a.com/1/2/3", "http://b.org" + "/x" * 41, "http://b.org" + "/x" * 39, "http://b.org"]
    df = spark.createDataFrame([(i, u, D(5)) for i, u in enumerate(urls)], "page_id bigint, url string, fetched_at timestamp")
    got = {r.page_id: (r.blocked, r.active) for r in ul.evaluate(df, entries(spark, log)).collect()}
    for i, u in enumerate(urls):
        n = sum(covers(p.rstrip("/"), u) for _, p, _, _ in log)
        assert got[i] == (n > 0, n), u


def test_nulls_repeats_clashes_and_empty(spark):
    schema = "page_id bigint, url string, fetched_at timestamp, host string, q int, id int, blocked_id int"
    rows = [(1, None, D(5)), (2, "nonsense", D(5)), (3, "http://a.com", None), (4, "http://a.com", D(5)), (4, "http://a.com", D(5)), (None, "http://a.com/", D(5)), (5, "", D(5)), (6, "http://" + "b." * 3000 + "com/" + "p/" * 5000, D(5))]
    df = spark.createDataFrame([(*r, "h", 1, 2, 3) for r in rows], schema)
    log = entries(spark, [("l", "a.com", D(1), "add")])
    got = sorted((r.page_id or 0, r.blocked) for r in ul.evaluate(df, log).collect())
    assert got == [(0, True), (1, False), (2, False), (3, False), (4, True), (4, True), (5, False), (6, False)]
    out = ul.allowed(df, log)
    assert out.columns == df.columns and sorted(r.page_id or 0 for r in out.collect()) == [0, 1, 2, 3, 5, 6]
    assert ul.evaluate(df.limit(0), log).count() == 0
    assert ul.evaluate(df, log.limit(0)).where("blocked").count() == 0


def test_addresses_ports_and_bare_names(spark):
    log = [("l", "[2001:DB8::1]/x", D(1), "add"), ("l", "10.0.0.1", D(1), "add"), ("l", "0.1", D(1), "add"), ("l", "http://u@b.org:8080//p/?q", D(1), "add")]
    urls = {"http://[2001:db8::1]:80/x/y": 1, "http://[2001:db8::1]/z": 0, "http://10.0.0.1/a": 1, "http://9.10.0.0.1/": 0, "b.org/p/1": 1, "WWW.b.org:81/p": 1, "b.org": 0, "mailto:x@b.org": 0, "s.b.org//p": 1}
    df = spark.createDataFrame([(i, u, D(5)) for i, u in enumerate(urls)], "page_id bigint, url string, fetched_at timestamp")
    got = {r.page_id: r.active for r in ul.evaluate(df, entries(spark, log)).collect()}
    assert got == dict(enumerate(urls.values()))
