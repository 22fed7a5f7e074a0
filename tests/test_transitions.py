from docketry.operators import transitions
from docketry.sources import posts
from pyspark.sql import functions as F


def test_upsert_takes_the_last_and_new_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "k int, v string, n int")
    assert sorted(map(tuple, transitions.upserted(old, new, ["k"], ["n"]).collect())) == [(1, "a"), (2, "d"), (3, None)]
    assert transitions.upserted(old.limit(0), new.limit(0), ["k"], ["n"]).count() == 0


def test_summary_versions_need_a_verified_sentence(spark):
    old = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True)], "reg_id int, version int, is_current boolean")
    fresh = spark.createDataFrame([(1, 3), (2, 0), (5, 1)], "reg_id int, sentences int")
    assert sorted(map(tuple, transitions.summary_versions(old, fresh).collect())) == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True), (5, 1, True)]


def test_effective_basis(spark):
    rows = [("q", True, True, "s", True), ("q", True, False, "s", True), ("q", False, True, "s", False), (None, False, False, None, True)]
    docs = spark.createDataFrame(rows, "q string, clause boolean, found boolean, s string, own boolean")
    got = [tuple(r.x) for r in docs.select(transitions.effective_basis(*map(F.col, docs.columns)).alias("x")).collect()]
    assert got == [("q", "model", False), ("s", "text", True), (None, None, False), (None, None, False)]


def test_main_text_prefers_the_selector_then_length(spark):
    rows = [("s", "m" * 60, "b"), ("", "m" * 50, "b" * 90), (None, "m" * 49, "b" * 50), (None, "m" * 49, "b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "s string, m string, b string")
    got = [tuple(r.x) for r in docs.select(transitions.main_text(*map(F.col, docs.columns)).alias("x")).collect()]
    assert got == [("s", "html_selector"), ("m" * 50, "html"), ("b" * 50, "html_body"), ("m" * 49, "html_body"), ("", "html_body")]


def test_listing_text_keeps_plain_extras(spark):
    rows = ['{"title": "T", "summary": "S", "extra": {"a": 1, "b": "x", "c": [1], "d": null, "e": {"f": 1}}}', '{"title": "T"}', "{}", "no json", None]
    got = [r.t for r in spark.createDataFrame([(r,) for r in rows], "body string").select(posts.listing_text("body").alias("t")).collect()]
    assert got == ["T\nS\na: 1\nb: x", "T", "", None, None]


def test_wordpress_addresses_and_categories(spark):
    docs = spark.createDataFrame([(7, "s-7", "http://old/x", " A &amp; B", "2024-02-03T01:02:03", "m", [5, 2, 1]), (8, None, None, None, None, None, None)], "id int, slug string, link string, title string, date string, modified string, categories array<int>")
    first, second = (tuple(r) for r in posts.wordpress_items(docs, "p", template="https://n/{slug}/{id}", categories={"1": "one", "2": "two"}).withColumn("day", F.col("day").cast("string")).collect())
    assert first == ("p:7", "https://n/s-7/7", "A & B", "2024-02-03", "two", "m")
    assert second[:2] == ("p:8", "https://n//8") and second[3:] == (None, None, None)
    assert posts.wordpress_items(docs, "p", rewrite=("http://old", "https://new")).first().url == "https://new/x"
