"""The relations of the engine, bound to the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every "now" of the queries.
AS_OF_DATE = "2001-08-01"
AS_OF_TIME = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: orders with customer and nation."""
    read = lambda name: table(spark, sf_dir, name)
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", 4).when(F.col("o_orderpriority") == "2-HIGH", 3)
    severity = severity.when(F.col("o_orderpriority") == "3-MEDIUM", 2).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
    status = F.when(key % 11 == 0, "AI_FAILED").when(key % 11 == 1, "SUMMARIZED").when(key % 11 == 2, "RELEVANT").when(key % 11 == 3, "NEW").otherwise("READY")
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("reg_id"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("title"),
        F.col("n_name").alias("issuer"),
        severity.alias("severity"),
        day.alias("publish_date"),
        F.when(key % 7 != 0, F.date_add(day, (key % 120).cast("int"))).alias("effective_date"),
        F.col("o_orderdate").alias("detected_at"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("review_status"),
        status.alias("processing_status"),
        (key % 10 != 3).alias("is_relevant"),
        ((key % 100) / 100.0).alias("score"),
        (key % 5).cast("int").alias("ai_attempts"),
    )


RECORDS = """rec AS (
    SELECT o_orderkey AS reg_id, c_name || ' ' || o_orderpriority AS title, n_name AS issuer,
        CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS severity,
        CAST(o_orderdate AS DATE) AS publish_date,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) END AS effective_date,
        o_orderdate AS detected_at,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS review_status,
        CASE o_orderkey % 11 WHEN 0 THEN 'AI_FAILED' WHEN 1 THEN 'SUMMARIZED' WHEN 2 THEN 'RELEVANT' WHEN 3 THEN 'NEW' ELSE 'READY' END AS processing_status,
        o_orderkey % 10 <> 3 AS is_relevant, (o_orderkey % 100) / 100.0 AS score, CAST(o_orderkey % 5 AS INTEGER) AS ai_attempts
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit suggestions of the records: lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("reg_id"),
        F.col("l_suppkey").alias("unit"),
        F.col("l_linenumber").alias("rank"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_returnflag") != "R").alias("is_active"),
        F.when(F.col("l_linestatus") == "F", "manual").otherwise("ai").alias("origin"),
    )


SUGGESTIONS = """sug AS (
    SELECT l_orderkey AS reg_id, l_suppkey AS unit, l_linenumber AS rank, l_discount * 10 AS score,
        l_returnflag <> 'R' AS is_active, CASE WHEN l_linestatus = 'F' THEN 'manual' ELSE 'ai' END AS origin
    FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and arrivals of sources: events, an error being a failed run."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 12).alias("source"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").otherwise("success").alias("status"),
        F.col("event_type").alias("task"),
        F.col("value").alias("latency"),
    )


RUNS = """run AS (
    SELECT event_id AS run_id, user_id % 12 AS source, ts AS started_at,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status,
        event_type AS task, value AS latency
    FROM events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the decisions of two systems, an evaluation set."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.concat(F.lit("s"), (i % 4).cast("string")).alias("stratum"),
        "source",
        F.when(i % 13 != 0, F.col("quality") == 1).alias("expected"),
        F.when(i % 17 != 0, i % 5 != 1).alias("a"),
        F.when(i % 19 != 0, (i % 7 != 1) | (F.col("toxic") == 1)).alias("b"),
        ((i * 37) % 100 / 100.0).alias("score"),
        (i % 23 == 0).alias("uncertain"),
        (F.col("n_chars") >= 200).alias("has_text"),
        (i % 5).cast("int").alias("severity"),
        ((i + F.col("toxic")) % 5).cast("int").alias("severity_expected"),
    )


JUDGED = """item AS (
    SELECT doc_id, 's' || doc_id % 4 AS stratum, source,
        CASE WHEN doc_id % 13 <> 0 THEN quality = 1 END AS expected,
        CASE WHEN doc_id % 17 <> 0 THEN doc_id % 5 <> 1 END AS a,
        CASE WHEN doc_id % 19 <> 0 THEN doc_id % 7 <> 1 OR toxic = 1 END AS b,
        (doc_id * 37) % 100 / 100.0 AS score, doc_id % 23 = 0 AS uncertain, n_chars >= 200 AS has_text,
        CAST(doc_id % 5 AS INTEGER) AS severity, CAST((doc_id + toxic) % 5 AS INTEGER) AS severity_expected
    FROM documents JOIN labels USING (doc_id))"""


def publication_id() -> Column:
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")


PUBLICATION_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications of the records: lineitem."""
    k, doc = F.col("l_suppkey") % 12, publication_id()
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("reg_id"),
        doc.alias("doc_id"),
        F.concat(F.lit("s"), k.cast("string")).alias("source"),
        F.when(F.col("l_returnflag") == "R", "attachment").otherwise("main").alias("role"),
        (k == 3).alias("gazette"),
        F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/d/"), (F.col("l_partkey") % 90).cast("string"))).alias("url"),
        F.concat(F.lit("doc "), (F.col("l_partkey") % 50).cast("string")).alias("title"),
        F.when(F.col("l_linestatus") == "F", (F.col("l_quantity") * 20).cast("long")).otherwise(F.lit(0)).cast("long").alias("n_text"),
    )


LINKS = f"""lnk AS (
    SELECT l_orderkey AS reg_id, {PUBLICATION_ID} AS doc_id, 's' || l_suppkey % 12 AS source,
        CASE WHEN l_returnflag = 'R' THEN 'attachment' ELSE 'main' END AS role, l_suppkey % 12 = 3 AS gazette,
        CASE WHEN l_partkey % 4 <> 0 THEN 'https://s' || l_suppkey % 12 || '.example/d/' || l_partkey % 90 END AS url,
        'doc ' || l_partkey % 50 AS title, CAST(CASE WHEN l_linestatus = 'F' THEN trunc(l_quantity * 20) ELSE 0 END AS BIGINT) AS n_text
    FROM lineitem)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did to records: events."""
    kind = F.when(F.col("event_type") == "view", "viewed").when(F.col("event_type") == "purchase", "decided").when(F.col("event_type") == "signup", "content_edited").when(F.col("event_type") == "click", "units_changed")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 400).alias("reg_id"),
        kind.otherwise("reopened").alias("kind"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("actor"),
        F.col("ts").alias("at"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("value"),
    )


HISTORY = """his AS (
    SELECT event_id, event_id % 400 AS reg_id, CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'decided'
        WHEN 'signup' THEN 'content_edited' WHEN 'click' THEN 'units_changed' ELSE 'reopened' END AS kind,
        'u' || user_id % 20 AS actor, ts AS moment, 'v' || user_id % 3 AS value
    FROM events)"""
