import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import redirect_filter as rf
from docketry.llm.common import attach
from docketry.llm.queries import URL_RULES


def split(url):
    found = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (found[2].translate(lower), found[3]) if found else ("", "")


def rule_of(url, rules):
    host, path = split(url)
    fit = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def judged(spark, rows, rules=URL_RULES, redirects=None):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, verdict string, comp int")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rf.judge(frame, rules, redirects).collect()}


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head><body>x</body></html>'


def test_rules_by_the_longest_text(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.example.org", "badexample.org", "x.com", "com", "b.example.net", "", "a.b:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/es/", "/fr/#de", "/de/x", "/FR/"]
    rows = [(n, f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}", None) for n in range(150)]
    rows += [(900, None, None), (901, "", None), (902, "org/", None), (903, "a://b://org/", ""), (904, "http://é.org/é", None)]
    got = judged(spark, rows)
    for n, url, _ in rows:
        rule, verdict = rule_of(url, URL_RULES)
        assert got[n][:3] == (*split(url), rule), url
        if verdict:
            assert got[n][3] == verdict
    assert len(got) == len(rows)


def test_blocks_spread_to_aliases_and_allows_hold(spark):
    rules = [("bad.net", "/", "block"), ("good.net", "/", "allow")]
    rows = [
        (1, "http://a.net/1", link("https://b.net/2")),
        (2, "http://b.net/2", link("/3")),
        (3, "http://b.net/3", "<META HTTP-EQUIV='refresh' CONTENT=\"0; URL=//bad.net/x\">"),
        (4, "http://good.net/4", link("http://bad.net/y")),
        (5, "http://c.net/5", link("http://good.net/4")),
        (6, "http://bad.net/6", None),
        (7, "http://d.net/7", "<!-- " + link("http://bad.net/6") + " --><script>'" + link("http://bad.net/6") + "'</script>" + link("#top")),
        (8, "https://www.a.net/1/?utm_source=f#x", None),
        (9, "http://e.net/9", link("mailto:x@bad.net") + link("")),
        (10, None, link("http://bad.net/6")),
        (11, "http://f.net/11", "<link href='http://f.net/q?a=1&amp;b=2' rel=canonical>"),
        (12, "http://f.net/q?a=1&b=2", None),
    ]
    moved = spark.createDataFrame([("http://f.net/q?a=1&b=2", "http://g.net/"), ("http://g.net", "http://bad.net/z"), (None, "http://bad.net/"), ("http://h.net/", None)], "url string, target string")
    got = {n: v[3] for n, v in judged(spark, rows, rules, moved).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "block"}
    assert {n: v[3] for n, v in judged(spark, rows, rules).items()}[11] == "allow"


def test_a_chain_a_star_and_repeated_rows(spark):
    rules = [("bad.net", "/", "block")]
    rows = [(n, f"http://a.net/p{n}", link(f"http://a.net/p{n + 1}")) for n in range(40)] + [(40, "http://a.net/p40", link("http://bad.net/"))]
    rows += [(100 + n, f"http://s.net/p{n}", link("http://hub.net/")) for n in range(200)]
    got = judged(spark, rows + [(500, "http://a.net/p3", None), (501, "http://a.net/p3", None)], rules)
    assert {got[n][3] for n in [*range(41), 500, 501]} == {"block"} and {got[100 + n][3] for n in range(200)} == {"allow"}
    twice = spark.createDataFrame([(1, "http://x.org/", "")] * 3, "page_id long, url string, html string")
    assert rf.judge(twice, URL_RULES).count() == 3
    assert rf.judge(twice.limit(0), URL_RULES).collect() == []
    assert rf.judge(twice, []).first()["verdict"] == "allow"


def test_many_rules_are_joined_with_the_same_result(spark):
    rng = random.Random(8)
    rules = [(rng.choice(["org", "a.org", "b.a.org", "net"]), "/" + rng.choice(["", "a", "ab", "b/", "b/c"]), rng.choice(["allow", "block"])) for _ in range(30)]
    urls = [(n, f"http://{rng.choice(['x.org', 'a.org', 'b.a.org', 'c.b.a.org', 'q.net', 'com'])}/{rng.choice(['', 'a', 'abc', 'b/', 'b/cd', 'z'])}") for n in range(200)]
    frame = spark.createDataFrame(urls, "n long, url string").withColumn("host", rf.url_host(F.col("url"))).withColumn("path", rf.url_path(F.col("url")))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    a, b = ({r["n"]: (r["rule"], r["verdict"]) for r in rf.with_rules(frame, x).collect()} for x in (rules, table))
    assert a == b == {n: rule_of(u, rules) for n, u in urls}
    with pytest.raises(ValueError):
        rf.rule_of(F.col("host"), F.col("path"), [("org", "/", "maybe")])


def test_plain_forms(spark):
    urls = {"http://WWW.m.A.net:80/x/index.html?utm_a=1&b=2&utm_c=3#f": "a.net/x?b=2", "https://a.net/": "a.net", "https://a.net?utm_x": "a.net", "x": None, "http://a.net/y//?": "a.net/y"}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["p"] for r in frame.select("u", rf.plain_form(F.col("u")).alias("p")).collect()} == urls


def test_a_side_over_the_bound_is_never_broadcast(spark):
    """Its packed files are far smaller than its copies, which the planner doesn't see."""
    rows = spark.range(2000).select(F.concat(F.lit("https://a.example/"), F.col("id")).alias("plain"), F.col("id").alias("page_id"))
    totals = rows.where("page_id % 2 = 0").select("plain", F.lit(True).alias("bad"))
    joined = attach(rows, totals, ["plain"], salt="page_id", most=1000)
    assert joined.where("bad").count() == 1000 and joined.count() == 2000
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
