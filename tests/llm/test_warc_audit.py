import hashlib

import duckdb
import pyarrow.parquet as pq
from conftest import DATA
from pyspark.sql import functions as F

from docketry.llm import warc_audit as w
from docketry.llm.common import shared_dir
from docketry.llm.queries import DAMAGED, ORACLE_SQL, op3_warc_audit

ODD = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "http://b\r\nX: y", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb"), (None, "u", ""), (5, "http://é", "ü" * 5000), (5, "http://é", "ü" * 5000)]


def written(spark, rows, name, per_file=1000):
    path = shared_dir(spark, name)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    w.write_warc(frame.select(w.record()), path, per_file)
    return path


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    assert set(con.sql(ORACLE_SQL["op3_warc_audit"]).fetchall()) == {tuple(r) for r in op3_warc_audit(spark, DATA).collect()}


def test_query_against_hashlib(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    want = {}
    for p in pages:
        body = (p["html"] or "").encode()
        text = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{p['page_id']}>\r\nWARC-Target-URI: {p['url'] or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        want[p["page_id"]] = (len(text), hashlib.sha256(text).hexdigest(), p["page_id"] % DAMAGED[0] != DAMAGED[1])
    assert {r[0]: tuple(r)[1:] for r in op3_warc_audit(spark, DATA).collect()} == want


def test_round_trip_of_odd_pages(spark):
    got = w.read_warc(spark, written(spark, ODD, "odd"), text=True).orderBy("ordinal").collect()
    assert [(r["record_id"], r["html"]) for r in got] == [(f"<urn:page:{'' if i is None else i}>", t or "") for i, _, t in ODD]
    assert [r["uri"] for r in got][2] == "http://b  X: y"
    assert w.read_warc(spark, written(spark, [], "none")).count() == 0


def hurt(spark, a, b):
    return sorted((r["record_id"], r["sha256"] is None) for r in w.audit(spark, a, b).where("not intact").collect())


def test_only_damaged_records_are_located(spark):
    rows = [(i, f"http://{i}", "z" * (i % 50)) for i in range(9000)]
    a, c = written(spark, rows, "a", 5000), written(spark, rows[:-1], "c", 5000)
    name = lambda i: f"<urn:page:{i}>"
    for change in (lambda t: t + "!", lambda t: "é" + t[1:]):
        bad = [(i, u, change(t) if i in (70, 8191) else t) for i, u, t in rows]
        assert hurt(spark, a, written(spark, bad, "b", 5000)) == [(name(70), False), (name(8191), False)]
    without = [r for r in rows if r[0] != 100]
    assert hurt(spark, a, written(spark, without[:8000] + [(-1, "", "new")] + without[8000:], "d", 5000)) == [(name(-1), True), (name(100), False)]
    assert hurt(spark, a, a) == []
    assert hurt(spark, a, c) == [(name(8999), False)]
    assert hurt(spark, c, a) == [(name(8999), True)]
    empty = written(spark, [], "none")
    assert w.audit(spark, empty, empty).count() == 0


def test_stored_tree_and_repeated_records(spark):
    rows = [(i, f"http://{i}", "z" * (i % 50)) for i in range(9000)]
    path = shared_dir(spark, "tree")
    w.write_tree(w.read_warc(spark, written(spark, rows, "a", 5000)), path)
    tree = w.read_tree(spark, path)
    assert [t.count() for t in tree] == [9000, 79 + 63, 2 + 1, 2][: len(tree)] and tree[-1].select(F.max("place")).first()[0] == 0
    same = [(1, "u", "x")] * 5 + [(1, "u", "y")] * 2
    assert hurt(spark, written(spark, same, "s"), written(spark, same[1:], "t")) == [("<urn:page:1>", False)]
    big = [(1, "u", "x"), (2, "u", "é" * 100_000), (3, "u", "z" * 3_000_000), (4, "u", "y" * 70_000)]
    path = written(spark, big, "big")
    assert w.read_warc(spark, path).select("shard").distinct().count() == 3
    assert hurt(spark, path, written(spark, [*big[:2], (3, "u", "z"), big[3]], "less")) == [("<urn:page:3>", False)]


def test_damaged_header_keeps_later_records():
    data = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % i for i in range(4))
    broken = data.replace(b"Content-Length: 3", b"Content-Length: x", 1)
    assert [r.record_id for r in w.parse_warc(data)] == ["<0>", "<1>", "<2>", "<3>"]
    assert [r.record_id for r in w.parse_warc(broken)] == ["", "<1>", "<2>", "<3>"]
    assert [(r.offset, r.n_bytes) for r in w.parse_warc(broken)] == [(r.offset, r.n_bytes) for r in w.parse_warc(data)]
