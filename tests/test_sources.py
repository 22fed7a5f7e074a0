import datetime as dt

from pyspark.sql import functions as F

from docketry.operators import candidates, changes, inbox, ladder, linking, monitoring
from docketry.sources import files, listings


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B –</title><link>http://h.org/1</link><pubDate>Sat, 05 Sep 2026 10:00:00 +0300</pubDate></item></channel></rss>")
    row = listings.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (row["url"], row["title"], row["day"]) == ("https://h.org/1", "A & B", dt.date(2026, 9, 5))


def test_jsonl_and_lists(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('// note\n\n{"id": 1}\n  {"id": 2}\n')
    assert [r["id"] for r in files.read_jsonl(spark, str(tmp_path / "s.jsonl"), "id int").orderBy("id").collect()] == [1, 2]
    (tmp_path / "l.csv").write_text("Başlık;Kurum;Birimler\nX;SPK;a, b;\n;TBB;c\n")
    rows = files.read_list(spark, str(tmp_path / "l.csv")).select("title", files.split_units(F.col("units")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("X", ["a", "b"])]


def test_blobs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, content string")
    for _ in range(2):
        assert files.store_blobs(rows, str(tmp_path / "blobs")).count() == 3
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2


def test_sheet_and_chart(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 2)], "a string, b int")
    files.write_sheet(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "o")).first()["a"] == "'=1"
    nodes = spark.createDataFrame([("x", "X", 2)], "id string, label string, n long")
    edges = spark.createDataFrame([("x", "x", "yeniden")], "a string, b string, label string")
    assert files.mermaid(nodes, edges).first()["text"] == 'flowchart LR\n  x["X (2)"]\n  x -.->|yeniden| x'


def test_addresses(spark):
    t = spark.createDataFrame([("http://h/{year}",), ("http://h/all",)], "url string")
    got = [r["url"] for r in listings.expand_urls(t, F.lit("2026-01-10").cast("date")).orderBy("url").collect()]
    assert got == ["http://h/2025", "http://h/2026", "http://h/all"]
    one = spark.range(1).select(
        listings.page_number(F.lit("http://h/?page=2&x=1"), 7).alias("p"),
        changes.canonical_link(F.lit("https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=5411&MevzuatTur=1&MevzuatTertip=5")).alias("c"),
        changes.canonical_link(F.lit("https://h.org/")).alias("n"),
    ).first()
    assert tuple(one) == ("http://h/?page=7&x=1", "mevzuat.gov.tr:1.5.5411", None)
    items = spark.createDataFrame([(1, None, "a"), (2, "S", "b"), (3, None, "c")], "place long, header string, title string").withColumn("page_id", F.lit(1))
    assert [(r["title"], r["section"]) for r in listings.carried_sections(items).orderBy("place").collect()] == [("a", None), ("c", "S")]


def test_unknown_criteria_are_refused(spark):
    import pytest

    for bad in (lambda q: inbox.metric("x", q), lambda q: inbox.effective_within(("x",), q)):
        with pytest.raises(ValueError):
            bad(inbox.ListQuery("2026-01-01"))


def test_business_hours_over_a_weekend(spark):
    spans = spark.createDataFrame([(1, dt.datetime(2026, 9, 18, 9), dt.datetime(2026, 9, 21, 9)), (2, dt.datetime(2026, 9, 19, 1), dt.datetime(2026, 9, 19, 5)), (3, None, None)], "id long, start timestamp, end timestamp")
    none = spark.createDataFrame([], "day date")
    got = {r["id"]: r["business_hours"] for r in monitoring.business_hours(spans, none, "UTC").collect()}
    assert got == {1: 24.0, 2: 0.0, 3: 0.0}


def test_four_copies_become_one_record(spark):
    title = "bankaların kredi işlemlerine ilişkin yönetmelik"
    rows = [
        (1, "gazette", "http://g.org/1", "BDDK", "karar", "11572", None, title, "2026-09-18"),
        (2, "agency", "http://a.org/x", "BDDK", "karar", "11572", None, title + " hakkında", "2026-09-18"),
        (3, "union", "http://u.org/y", "BDDK", None, None, None, title + " hakkında", "2026-09-19"),
        (4, "other", "http://o.org/z", "SPK", None, None, None, "sermaye piyasası araçları tebliği metni", "2026-09-19"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, url string, issuer string, kind string, decision_no string, sequence_no string, title_key string, day string").withColumn("day", F.to_date("day")).withColumn("text", F.lit("")).withColumn("title", F.col("title_key"))
    links = ladder.link_ladder(docs, linking.document_keys(docs), candidates.fuzzy_candidates(docs))
    assert {r["doc_id"]: r["record"] for r in links.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    golden = {r["record"]: r["sources"] for r in linking.golden_records(docs, links).collect()}
    assert golden == {1: "agency,gazette,union", 4: "other"}


def test_merge_pointers_with_a_cycle(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "reg_id long, into long")
    assert {tuple(r) for r in linking.follow_merges(p).collect()} == {(1, 3), (2, 3), (5, 5), (6, 6)}
