import os
import tempfile

import duckdb
import numpy as np
from nearfield.llm.queries import OP3_SQL, URL_RULES, all_queries
from nearfield.llm.url_filter import DigestArray, RuleIndex, _judge_by_join, judge_urls, url_host, url_path

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "://", "http://", "http://X.ORG", "http://x.org/", "HTTP://Sub.Example.ORG/es/a?b#c", "http://example.org/en/1",
        "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/", "http://com/fr/", "http://a.com/fr", "http://a.com/de/#x",
        "http://a.com?x://b.org/", "x://y.org/://z.com/de/", "http://ÉX.com/de/é", "http://org./", "http://..org/x", "http://a.net/" + "p" * 20_000]


def brute(url):
    cut = (url or "").find("://")
    rest = "" if cut < 0 else url[cut + 3 :]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0] + [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in URL_RULES:
        rh, rp = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, best[0] if best else None, best[1] if best else "allow")


def pages_of(spark):
    return spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, host string, rule string")


def test_odd_urls(spark):
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    pages = pages_of(spark)
    for _ in range(2):  # a second call ships its own files
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
        assert got == {i: brute(u) for i, u in enumerate([*URLS, *URLS])}
    joined = judge_urls(pages, rules, max_index_bytes=0)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == got
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_join_form_equals_index_form(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    src = pages.select(pages.page_id.alias("id"), url_host(pages.url).alias("host"), url_path(pages.url).alias("path"))
    a = sorted(map(tuple, _judge_by_join(src, rules, "allow").select("id", "host", "path", "rule", "verdict").collect()))
    b = sorted(map(tuple, judge_urls(pages, rules).collect()))
    assert a == b


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    rel = con.sql(OP3_SQL)
    df = all_queries()["op3_urls"](spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_colliding_digests_are_told_apart_by_their_strings():
    path = os.path.join(tempfile.mkdtemp(), "x")
    strings = [f"s{i}" for i in range(50)]
    clash = lambda raw: int(raw[-1]) % 3  # noqa: E731 - almost everything collides
    DigestArray.write(path, strings, list(range(50)), clash)
    found = DigestArray(path, clash).find([*strings, "s50", "t1"])
    assert found.tolist() == [*range(50), -1, -1]
    DigestArray.write(path, [], [])
    assert DigestArray(path).find(["a"]).tolist() == [-1]


def test_longest_rule_wins():
    folder = tempfile.mkdtemp()
    rules = ["a.b", "b", "b/x", "a.b/x/y", "c/longer"]
    name, _ = RuleIndex.write(folder, rules)
    index = RuleIndex(folder, name)
    got = index.longest(["z.a.b", "b", "a.b", "q.b", "c", "bb"], ["/x/y/z", "/x", "", "/y", "/long", "/x"])
    assert got == [3, 2, 0, 1, -1, -1]
    assert isinstance(index.rules.keys, np.memmap)


def test_long_hosts_cost_linear_time(spark):
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    host = "a." * 200_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/x")], "page_id bigint, url string")
    for bound in (1 << 20, 0):
        got = judge_urls(pages, rules, max_index_bytes=bound).first()
        assert (got.rule, got.verdict, len(got.host)) == ("example.org/es/", "block", len(host))


def test_the_kernel_holds_no_rules(spark):
    """What travels with the function doesn't grow with the rules: their strings and verdicts are read from the mapped file."""
    pages = pages_of(spark)
    sizes = []
    for n in (1, 5000):
        listed = [(f"host{i}.example.org/" + "p" * 40, f"verdict {i % 700}" if i % 9 else None) for i in range(n)] + [("net/", "v")]
        folder = tempfile.mkdtemp()
        name, _ = RuleIndex.write(folder, [r for r, _ in listed], [v for _, v in listed])
        index = RuleIndex(folder, name)
        at = index.places([r.split("/")[0] for r, _ in listed], ["/" + "p" * 41] * n + ["/"])
        assert [(index.rule(k), index.verdict(k, "none")) for k in at] == [(r, v or "none") for r, v in listed]
        judged = judge_urls(pages, spark.createDataFrame(listed, "rule string, verdict string"))
        # the Python function of the plan, as it is sent to the workers
        stack = [judged._jdf.queryExecution().analyzed()]
        while stack:
            node = stack.pop()
            if node.nodeName() == "MapInArrow":
                sizes.append(node.functionExpr().func().command().size())
            stack += [node.children().apply(i) for i in range(node.children().size())]
    assert len(sizes) == 2 and sizes[1] < sizes[0] + 500
