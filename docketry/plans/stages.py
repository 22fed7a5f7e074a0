"""Queries of what stages write, of posts and of stored list rows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import changes, evaluation, monitoring, queues, summaries, transitions
from docketry.sources import posts

from . import bindings as b
from .bindings import RECORDS, RUNS, SUGGESTIONS
from .catalogue import ARRIVED, NOW, _claims, _holidays, now, query


def _raw(spark, sf):
    """Raw documents: events; three of four are attachments of the fourth before them."""
    i = F.col("event_id")
    return b.table(spark, sf, "events").select(
        i.alias("doc_id"),
        F.when(i % 4 != 0, i - i % 4).alias("parent"),
        F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"),
        F.col("event_type").alias("channel"),
        F.when(i % 4 != 0, "attachment").otherwise("main").alias("role"),
        F.concat(F.lit("https://d.example/"), (i % 7).cast("string")).alias("url"),
        (i % 5 != 2).alias("is_latest"),
    )


RAW = """raw AS (
    SELECT event_id AS doc_id, CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 END AS parent, 's' || user_id % 12 AS source, event_type AS channel,
        CASE WHEN event_id % 4 <> 0 THEN 'attachment' ELSE 'main' END AS role, 'https://d.example/' || event_id % 7 AS url, event_id % 5 <> 2 AS is_latest
    FROM events)"""


@query(f"""WITH {RAW}, kids AS (SELECT parent, string_agg(DISTINCT url, ',' ORDER BY url) AS attachments FROM raw WHERE is_latest AND parent IS NOT NULL GROUP BY parent)
    SELECT doc_id, channel, url, coalesce(attachments, '') AS attachments FROM raw LEFT JOIN kids ON kids.parent = raw.doc_id
    WHERE is_latest AND source = 's3' AND role <> 'attachment' AND channel IN ('click', 'view')""")
def main_documents(spark, sf):
    return transitions.main_documents(_raw(spark, sf), "s3", ["click", "view"])


@query("""WITH new AS (SELECT event_id * 2 - event_id % 3 AS ext_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS started_at FROM events GROUP BY 1)
    SELECT ext_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at
    FROM (SELECT event_id AS ext_id, event_type AS status, ts AS started_at FROM events WHERE event_id NOT IN (SELECT ext_id FROM new) UNION ALL SELECT * FROM new)""")
def run_ingest(spark, sf):
    """Stored runs, and runs told again, some more than once; the last to start counts."""
    i = F.col("event_id")
    told = b.table(spark, sf, "events").select(i, F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    new = told.select((i * 2 - i % 3).alias("ext_id"), "status", "started_at", i.alias("n"))
    done = transitions.upserted(told.withColumnRenamed("event_id", "ext_id"), new, ["ext_id"], ["started_at", "n"])
    return done.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"""WITH {RECORDS} SELECT reg_id, CASE WHEN is_relevant THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS processing_status,
    CASE WHEN reg_id % 9 = 0 THEN 'Düzenleme Taslağı' ELSE 'Tebliğ' END AS kind, CASE WHEN is_relevant THEN severity END AS severity FROM rec""")
def classification_write(spark, sf):
    """Every ninth title is that of a draft."""
    rows = b.records(spark, sf)
    titled = rows.withColumn("title", F.when(F.col("reg_id") % 9 == 0, F.concat("title", F.lit(" TASLAĞI"))).otherwise(F.col("title")))
    return transitions.classified(titled, rows.select("reg_id", F.col("is_relevant").alias("relevant"), F.lit("Tebliğ").alias("kind"), "severity"))


@query(f"""WITH {SUGGESTIONS}, kept AS (SELECT o_orderkey AS reg_id, 900 + k AS unit, (o_orderkey * 7 + k * 3) % 10 AS score FROM orders, range(3) AS r(k) WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 <> k)
    SELECT reg_id, unit, rank, origin, is_active AND NOT (reg_id % 3 = 0 AND origin = 'ai') AS is_active FROM sug
    UNION ALL SELECT reg_id, unit, row_number() OVER (PARTITION BY reg_id ORDER BY score DESC, unit), 'ai', true FROM kept""")
def unit_match_write(spark, sf):
    i, k = F.col("o_orderkey"), F.col("k")
    asked = b.table(spark, sf, "orders").where(i % 3 == 0).select(i.alias("reg_id"))
    kept = asked.withColumn("k", F.explode(F.array(*[F.lit(x) for x in range(3)]))).where(F.col("reg_id") % 6 != k)
    kept = kept.select("reg_id", (k + 900).cast("long").alias("unit"), ((F.col("reg_id") * 7 + k * 3) % 10).alias("score"))
    return transitions.matched_units(b.suggestions(spark, sf).select("reg_id", "unit", "rank", "origin", "is_active"), kept, asked)


@query("""WITH n AS (SELECT l_orderkey AS record, string_agg('p' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey) AS notes FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    d AS (SELECT l_orderkey AS record, arg_max(CAST(l_shipdate AS DATE), (l_linenumber, CAST(l_shipdate AS DATE))) AS effective FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT record, notes, CAST(effective AS VARCHAR) AS effective FROM n FULL JOIN d USING (record)""")
def map_notes(spark, sf):
    """Lines as notes of an order's chunks."""
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("place"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("point"), (F.col("l_returnflag") != "R").alias("found"), F.to_date("l_shipdate").cast("string").alias("value"), (F.col("l_linestatus") == "F").alias("dated"))
    return transitions.noted(lines, lines.select("record", "chunk", "value", F.col("dated").alias("found")))


@query("""WITH x AS (SELECT doc_id, 'q' || doc_id AS quote, doc_id % 2 = 0 AS clause, doc_id % 3 <> 0 AS found, CASE WHEN doc_id % 7 <> 0 THEN 's' || doc_id END AS sentence, doc_id % 5 <> 0 AS own FROM documents)
    SELECT doc_id, CASE WHEN clause AND found THEN quote WHEN own AND sentence IS NOT NULL THEN sentence END AS "text",
        CASE WHEN clause AND found THEN 'model' WHEN own AND sentence IS NOT NULL THEN 'text' END AS origin, clause AND NOT found AS removed FROM x""")
def effective_basis(spark, sf):
    i = F.col("doc_id")
    named = lambda letter: F.concat(F.lit(letter), i.cast("string"))
    basis = transitions.effective_basis(named("q"), i % 2 == 0, i % 3 != 0, F.when(i % 7 != 0, named("s")), i % 5 != 0)
    return b.table(spark, sf, "documents").select("doc_id", basis.alias("x")).select("doc_id", "x.*")


@query("""WITH old AS (SELECT event_id % 400 AS reg_id, row_number() OVER (PARTITION BY event_id % 400 ORDER BY event_id) AS version, count(*) OVER (PARTITION BY event_id % 400) AS n FROM events WHERE event_type = 'signup'),
    new AS (SELECT doc_id AS reg_id FROM documents WHERE doc_id % 4 > 0)
    SELECT reg_id, version, version = n AND reg_id NOT IN (SELECT reg_id FROM new) AS is_current FROM old
    UNION ALL SELECT new.reg_id, coalesce(max(version), 0) + 1, true FROM new LEFT JOIN old ON old.reg_id = new.reg_id GROUP BY new.reg_id""")
def summary_versions(spark, sf):
    from pyspark.sql import Window

    own = Window.partitionBy("reg_id")
    edits = b.table(spark, sf, "events").where("event_type = 'signup'").select((F.col("event_id") % 400).alias("reg_id"), "event_id")
    old = edits.select("reg_id", F.row_number().over(own.orderBy("event_id")).alias("version"), F.count("*").over(own).alias("n"))
    fresh = b.table(spark, sf, "documents").select(F.col("doc_id").alias("reg_id"), (F.col("doc_id") % 4).alias("sentences"))
    return transitions.summary_versions(old.select("reg_id", "version", (F.col("version") == F.col("n")).alias("is_current")), fresh)


@query(f"""WITH {RECORDS}, d AS (SELECT event_id % 400 AS reg_id, arg_max(user_id % 20, (ts, event_id)) AS unit, arg_max(event_type = 'click', (ts, event_id)) AS corrected FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1)
    SELECT reg_id, title || ' | topics: ' || CASE WHEN reg_id % 2 = 0 THEN 'a' || reg_id % 5 || ', b' ELSE '-' END AS input_text, 'u' || unit AS units, CASE WHEN corrected THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d JOIN rec USING (reg_id)""")
def example_pool(spark, sf):
    """Decisions of users; records with an even number have topics."""
    i = F.col("reg_id")
    events = b.table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    decided = events.select((F.col("event_id") % 400).alias("reg_id"), F.col("ts").alias("at"), "event_id", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("units"), (F.col("event_type") == "click").alias("corrected"))
    topics = F.when(i % 2 == 0, F.array(F.concat(F.lit("a"), (i % 5).cast("string")), F.lit("b")))
    return transitions.example_pool(decided, b.records(spark, sf).select("reg_id", "title", topics.alias("topics")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'url:' || doc_id % 50 WHEN doc_id % 3 = 1 THEN 'title:' || doc_id % 20 ELSE 'raw:' || doc_id END AS canonical_key,
    CASE WHEN doc_id % 4 = 0 THEN 'BASELINE' ELSE 'NEW' END AS processing_status, doc_id % 11 = 0 AS review FROM documents""")
def created_records(spark, sf):
    i = F.col("doc_id")
    docs = b.table(spark, sf, "documents").select("doc_id", (i % 4 == 0).alias("is_baseline"), F.when(i % 11 == 0, i - 1).alias("candidate"))
    key = lambda name, n, strong, place: F.struct(F.concat(F.lit(name), (i % n).cast("string")).alias("key"), F.lit(strong).alias("strong"), F.lit(place).alias("place"))
    keys = docs.where(i % 3 < 2).select("doc_id", F.explode(F.when(i % 3 == 0, F.array(key("title:", 20, False, 3), key("no:", 9, True, 2), key("url:", 50, True, 1))).otherwise(F.array(key("title:", 20, False, 3)))).alias("k"))
    return transitions.created_records(docs, keys.select("doc_id", "k.*"))


@query("""WITH o AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 4 <> 0 AND event_id % 5 = 0 THEN 'waiting' WHEN event_id % 3 = 0 THEN 'new'
        WHEN event_id % 4 = 0 AND event_id % 3 <> 1 THEN 'merged' ELSE 'linked' END AS o FROM events)
    SELECT count(*) FILTER (WHERE o <> 'skipped') AS processed, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o IN ('new', 'merged', 'linked')) AS linked, count(*) FILTER (WHERE o = 'new') AS new, count(*) FILTER (WHERE o = 'merged') AS merged FROM o""")
def step_report(spark, sf):
    i = F.col("doc_id")
    method = F.when(i % 3 == 0, "new").when(i % 3 == 1, "same_document").otherwise("key")
    docs = _raw(spark, sf).select("doc_id", "role", F.when(i % 13 == 0, "LINKED").otherwise("FETCHED").alias("status"), (i % 17 != 0).alias("extracted"), (i % 5 != 0).alias("parent_known"), method.alias("method"))
    return transitions.step_report(transitions.stepped(docs))


@query("""WITH g AS (SELECT l_orderkey AS reg_id, arg_min(l_suppkey % 6, (l_linenumber, l_suppkey % 6)) FILTER (WHERE l_linestatus = 'O') AS first,
        list(DISTINCT l_suppkey % 6) FILTER (WHERE l_linestatus = 'O') AS a, list(DISTINCT l_suppkey % 6) FILTER (WHERE l_returnflag <> 'A' AND l_linenumber > 1) AS f FROM lineitem GROUP BY 1)
    SELECT count(*) AS records, count(*) FILTER (WHERE list_contains(f, first)) AS top1, count(*) FILTER (WHERE list_has_any(a, f)) AS any_hit FROM g WHERE a IS NOT NULL AND f IS NOT NULL""")
def unit_hits(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("reg_id"), (F.col("l_suppkey") % 6).alias("unit"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_linestatus") == "O", "ai").otherwise("manual").alias("origin"), ((F.col("l_returnflag") != "A") & (F.col("l_linenumber") > 1)).alias("is_final"))
    return transitions.unit_hits(rows)


@query("""SELECT s_suppkey AS source, s_suppkey % 5 <> 0 AND (s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey % 3 = 0) OR (s_suppkey % 4 = 2 AND s_suppkey % 7 < 3)) AS deep FROM supplier""")
def deep_capable(spark, sf):
    """One channel that is never enabled and one of a strategy by the source's number."""
    i = F.col("s_suppkey")
    strategy = F.when(i % 4 == 0, "wordpress_api").when(i % 4 == 1, "css_list").when(i % 4 == 2, "json_api").otherwise("feed")
    channel = lambda enabled: F.struct(strategy.alias("strategy"), enabled.alias("enabled"), (i % 3 == 0).alias("pagination"), F.array(F.lit("https://a.example/"), F.when(i % 7 < 3, "https://a.example/?page=1").otherwise("https://a.example/?p=1")).alias("urls"))
    return b.table(spark, sf, "supplier").select(i.alias("source"), transitions.deep_capable(F.array(channel(F.lit(False)), channel(i % 5 != 0))).alias("deep"))


@query("""WITH last AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50), c AS (SELECT 'k' || (user_id + k) % 40 AS key, (event_id + k) % 3 AS s FROM last, range(3) AS r(k) WHERE event_id % 2 = 0)
    SELECT DISTINCT key FROM c WHERE s = 0""")
def done_chunks(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    crawl = F.array(*[F.struct(F.concat(F.lit("k"), ((u + k) % 40).cast("string")).alias("key"), F.when((i + k) % 3 == 0, "done").otherwise("failed").alias("status")) for k in range(3)])
    jobs = b.table(spark, sf, "events").where("event_type = 'purchase'").select(i.alias("job_id"), F.when(i % 2 == 0, "2024-01-01").otherwise("2023-01-01").alias("cutoff"), crawl.alias("crawl"))
    return transitions.done_chunks(jobs, "2024-01-01")


@query(f"""SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status,
    CASE WHEN event_id % 3 < 2 THEN CAST(round_even(epoch_us({NOW} - ts) / 1e6, 0) AS BIGINT) END AS elapsed, CASE WHEN event_id % 3 = 2 THEN CAST(event_id % 90 AS DOUBLE) END AS duration FROM events""")
def job_view(spark, sf):
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    status = F.when(i % 3 == 0, "queued").when(i % 3 == 1, "running").otherwise("done")
    end = F.when(i % 3 == 2, F.timestamp_micros(F.unix_micros(ts) + (i % 90) * 1_000_000))
    return transitions.job_view(b.table(spark, sf, "events").select(i.alias("job_id"), status.alias("status"), ts.alias("created_at"), F.when(i % 3 > 0, ts).alias("started_at"), end.alias("finished_at")), now())


@query("""SELECT doc_id AS item_id, quality = 1 AS expected, CASE WHEN doc_id % 6 <> 5 THEN doc_id % 5 <> 1 END AS predicted, CASE WHEN doc_id % 6 <> 5 THEN (doc_id * 37) % 100 / 100.0 END AS score,
    CASE WHEN doc_id % 3 <> 0 THEN 'high' END AS expected_severity, CASE WHEN doc_id % 6 <> 5 AND doc_id % 5 <> 1 AND doc_id % 3 <> 0 THEN 's' || doc_id % 4 END AS severity FROM labels""")
def evaluation_rows(spark, sf):
    """Every sixth item has no prediction."""
    i, labels = F.col("doc_id"), b.table(spark, sf, "labels")
    items = labels.select(i.alias("item_id"), (F.col("quality") == 1).alias("expected"), F.when(i % 3 != 0, "high").alias("expected_severity"))
    said = labels.where(i % 6 != 5).select(i.alias("item_id"), (i % 5 != 1).alias("relevant"), ((i * 37) % 100 / 100.0).alias("score"), F.concat(F.lit("s"), (i % 4).cast("string")).alias("severity"))
    return transitions.evaluated(items, said)


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS body, CASE WHEN doc_id % 4 = 0 THEN source ELSE '' END AS chosen, CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN repeat('m', 49) ELSE '' END AS main FROM documents)
    SELECT doc_id, CASE WHEN chosen <> '' THEN 'html_selector' WHEN length(main) >= 50 THEN 'html' ELSE 'html_body' END AS method,
        md5(CASE WHEN chosen <> '' THEN chosen WHEN length(main) >= 50 OR length(body) <= length(main) THEN main ELSE body END) AS digest FROM x""")
def main_text(spark, sf):
    i = F.col("doc_id")
    main = F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, F.repeat(F.lit("m"), F.lit(49)))
    found = transitions.main_text(F.when(i % 4 == 0, F.col("source")), main, F.col("text"))
    return b.table(spark, sf, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.method", F.md5("x.text").alias("digest"))


@query("""SELECT 'posts:' || page_id AS external_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS url, 'A & B ' || page_id AS title,
    CASE WHEN page_id % 5 <> 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS day, CASE WHEN page_id % 3 = 0 THEN 'law' WHEN page_id % 3 = 1 THEN 'notice' ELSE 'other' END AS category, 'v' || page_id % 4 AS version_key FROM pages""")
def wordpress_items(spark, sf):
    i = F.col("page_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"))
    # Category 2 isn't mapped.
    own = F.when(i % 3 == 2, F.array(F.lit(99), F.lit(2))).otherwise(F.array(F.lit(99), (i % 3).cast("int"), F.lit(0)))
    rows = b.table(spark, sf, "pages").select(i.alias("id"), F.lit("x").alias("slug"), F.col("url").alias("link"), F.concat(F.lit(" A &amp;  B "), i.cast("string")).alias("title"), F.when(i % 5 != 0, day).otherwise("soon").alias("date"), F.concat(F.lit("v"), (i % 4).cast("string")).alias("modified"), own.alias("categories"))
    found = posts.wordpress_items(rows, "posts", rewrite=("http://", "https://"), categories={"0": "law", "1": "notice"}, default="other")
    return found.withColumn("day", F.col("day").cast("string"))


@query("""SELECT doc_id, source || chr(10) || 's' || doc_id || chr(10) || 'lang: ' || coalesce(lang, 'none') || chr(10) || 'n: ' || n_chars AS "text" FROM documents""")
def listing_text(spark, sf):
    body = F.to_json(F.struct(F.col("source").alias("title"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary"), F.struct(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("n_chars").alias("n"), F.array(F.lit(1)).alias("tags")).alias("extra")))
    return b.table(spark, sf, "documents").select("doc_id", posts.listing_text(body).alias("text"))


def _summary_claims(spark, sf):
    """A sentence a document with a quote of its record and one of nothing, a topic with the latter alone, and a sentence that says nothing."""
    quotes, sources = _claims(spark, sf)
    nothing = F.lit("no such words stand in any of these sources at all")
    claim = lambda kind, place, said, q: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(said).alias("text"), q.alias("quotes"))
    three = F.array(claim("sentence", 0, " It says so. ", F.array("quote", nothing)), claim("topic", 1, "A topic", F.array(nothing)), claim("sentence", 2, "  ", F.array("quote")))
    return quotes.select("record", F.explode(three).alias("c"), F.col("item_id")).select("record", "c.kind", (F.col("item_id") * 10 + F.col("c.place")).alias("place"), "c.text", "c.quotes"), sources


@query()
def summary_claims(spark, sf):
    """Each claim of the records' summaries, and whether a quote bears it out."""
    return summaries.verified_claims(*_summary_claims(spark, sf))


@query()
def verified_summary(spark, sf):
    return summaries.verified_summaries(summaries.verified_claims(*_summary_claims(spark, sf))).select("record", F.size("sentences").alias("sentences"), F.size("topics").alias("topics"), "removed", "grounding")


@query("""WITH src AS (SELECT 's' || k AS source, k % 3 = 0 AS deep, k % 6 = 0 AS dated FROM range(14) AS r(k)),
    rec AS (SELECT 's' || o_orderkey % 12 AS source, CAST(o_orderdate AS DATE) AS publish_date FROM orders WHERE o_orderkey % 4 = 0),
    arc AS (SELECT 's' || l_suppkey % 12 AS source, CAST(l_shipdate AS DATE) + CAST(l_suppkey % 12 * 90 AS INTEGER) AS published_at FROM lineitem),
    b AS (SELECT src.*, coalesce((SELECT count(*) FROM rec WHERE rec.source = src.source AND publish_date >= DATE '1996-06-01'), 0) AS converted, (SELECT min(published_at) FROM arc WHERE arc.source = src.source) AS earliest FROM src),
    a AS (SELECT *, CASE WHEN earliest <= DATE '1996-06-01' THEN 'covered' WHEN deep THEN 'crawl' WHEN earliest IS NULL THEN 'crawl_shallow' ELSE 'shallow' END AS action FROM b)
    SELECT source, action, converted, CAST(earliest AS VARCHAR) AS earliest, CASE WHEN action = 'crawl' AND dated THEN '1996-06-01' END AS first,
        CASE WHEN action = 'crawl' AND dated THEN CAST(least(DATE '2001-08-01', coalesce(earliest - 1, DATE '2001-08-01')) AS VARCHAR) END AS last FROM a""")
def rebaseline_plan(spark, sf):
    k, day = F.col("id"), lambda c: F.to_date(c)
    name = lambda c: F.concat(F.lit("s"), c.cast("string")).alias("source")
    sources = spark.range(14).select(name(k), (k % 3 == 0).alias("deep"), (k % 6 == 0).alias("dated"))
    records = b.table(spark, sf, "orders").select(name(F.col("o_orderkey") % 12), F.when(F.col("o_orderkey") % 4 == 0, "BASELINE").otherwise("READY").alias("processing_status"), day("o_orderdate").alias("publish_date"))
    archived = b.table(spark, sf, "lineitem").select(name(F.col("l_suppkey") % 12), F.date_add(day("l_shipdate"), (F.col("l_suppkey") % 12 * 90).cast("int")).alias("published_at"))
    plan = changes.rebaseline_plan(sources, records, archived, F.lit("1996-06-01").cast("date"), F.lit(b.AS_OF_DATE).cast("date"))
    return plan.select("source", "action", "converted", *[F.col(c).cast("string").alias(c) for c in ("earliest", "first", "last")])


@query("""WITH s AS (SELECT doc_id, -1 AS turn, doc_id AS record, 'new' AS method FROM documents),
    n AS (SELECT l_partkey AS doc_id, l_linenumber * 1000000 + l_orderkey AS turn, l_orderkey AS record, 'key' AS method FROM lineitem WHERE l_linenumber < 3)
    SELECT doc_id, arg_max(record, (turn, record)) AS record, arg_max(method, (turn, record)) AS method FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY doc_id""")
def attached_links(spark, sf):
    """Documents that began records, and what lines of orders attach to them afterwards."""
    none = [F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("key")]
    stored = b.table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("record"), F.lit("new").alias("method"), *none)
    new = b.table(spark, sf, "lineitem").where("l_linenumber < 3").select(F.col("l_partkey").alias("doc_id"), F.col("l_orderkey").alias("record"), F.lit("key").alias("method"), *none, (F.col("l_linenumber") * 1000000 + F.col("l_orderkey")).cast("long").alias("turn"))
    return transitions.attached_links(stored, new).select("doc_id", "record", "method")


REVIEWED = f"""{RECORDS}, base AS (SELECT reg_id, title, is_relevant, CASE WHEN reg_id % 3 = 0 THEN 'IRRELEVANT' ELSE processing_status END AS status, reg_id % 9 = 0 AS reviewed, ai_attempts FROM rec),
    vd AS (SELECT o_orderkey AS reg_id, CASE WHEN o_custkey % 2 = 0 THEN 'relevant' ELSE 'confirm' END AS verdict FROM orders WHERE o_custkey % 5 < 2),
    dn AS (SELECT base.*, verdict FROM base LEFT JOIN vd ON vd.reg_id = base.reg_id AND status = 'IRRELEVANT' AND NOT reviewed)"""


def _reviews(spark, sf):
    i = F.col("reg_id")
    status = F.when(i % 3 == 0, "IRRELEVANT").otherwise(F.col("processing_status"))
    rows = b.records(spark, sf).select("reg_id", "title", F.lit("no rule applies").alias("rationale"), "is_relevant", status.alias("processing_status"), "detected_at", "ai_attempts", (i % 9 == 0).alias("reviewed"))
    verdicts = b.table(spark, sf, "orders").where("o_custkey % 5 < 2").select(F.col("o_orderkey").alias("reg_id"), F.when(F.col("o_custkey") % 2 == 0, "relevant").otherwise("confirm").alias("verdict"), F.lit(0).alias("place"))
    return transitions.irrelevant_reviews(rows, verdicts, now())


@query(f"""WITH {REVIEWED} SELECT reg_id, is_relevant OR verdict IS NOT DISTINCT FROM 'relevant' AS is_relevant, CASE WHEN verdict = 'relevant' THEN 'RELEVANT' ELSE status END AS status,
    CASE WHEN verdict = 'relevant' THEN 0 ELSE ai_attempts END AS ai_attempts, reviewed OR verdict IS NOT NULL AS reviewed FROM dn""")
def irrelevant_reviews(spark, sf):
    return _reviews(spark, sf)[0].select("reg_id", "is_relevant", F.col("processing_status").alias("status"), "ai_attempts", "reviewed")


@query(f"""WITH {REVIEWED} SELECT reg_id, title || ' | no rule applies' AS input_text, verdict = 'relevant' AS is_relevant, CASE verdict WHEN 'relevant' THEN 2.0 ELSE 1.0 END AS weight FROM dn WHERE verdict IS NOT NULL""")
def review_examples(spark, sf):
    return _reviews(spark, sf)[1].select("reg_id", "input_text", "is_relevant", "weight")


@query(f"""WITH {RUNS}, {ARRIVED}, g AS (SELECT source, lag(came) OVER (PARTITION BY source ORDER BY came) AS before, came FROM arrived),
    s AS (SELECT source, came, date_trunc('second', before) + INTERVAL 3 HOUR AS s, date_trunc('second', came) + INTERVAL 3 HOUR AS e, epoch(date_trunc('second', came)) - epoch(date_trunc('second', before)) AS wall FROM g),
    d AS (SELECT *, unnest(generate_series(CAST(s AS DATE), CAST(e AS DATE), INTERVAL 1 DAY)) AS day FROM s WHERE source < 6 AND s IS NOT NULL),
    w AS (SELECT source, came, round(sum((epoch(least(e, day + INTERVAL 1 DAY)) - epoch(greatest(s, day))) / 3600), 4) AS hours FROM d WHERE isodow(day) < 6 AND CAST(day AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-11', DATE '2024-01-12') GROUP BY 1, 2),
    x AS (SELECT s.source, CASE WHEN s.source < 6 AND s.s IS NOT NULL THEN CAST(round(coalesce(hours, 0) * 3600) AS BIGINT) ELSE CAST(wall AS BIGINT) END AS gap FROM s LEFT JOIN w USING (source, came)),
    t AS (SELECT source, count(*) FILTER (WHERE gap > 0) AS gaps, floor(quantile_cont(gap, 0.95) FILTER (WHERE gap > 0) + 1e-6) AS p95 FROM x GROUP BY source)
    SELECT source, gaps, round(CASE WHEN gaps >= 8 THEN greatest(p95 / 3600, 12.0) ELSE 48.0 END, 6) AS tolerance FROM t""")
def gap_tolerance_business(spark, sf):
    """Tolerances of which half the sources count business hours only."""
    runs = b.runs(spark, sf)
    found = monitoring.arrivals(runs, now() - F.expr("interval 90 days"))
    return monitoring.learned_tolerance(found, 48.0, in_business_hours=runs.where("source < 6").select("source").distinct(), holidays=_holidays(spark))


@query(f"""WITH q AS (SELECT event_id AS request_id, user_id % 12 AS source, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, ts + INTERVAL 2 HOUR AS finished_at FROM events),
    r AS (SELECT *, row_number() OVER (ORDER BY finished_at DESC, request_id DESC) AS n FROM q WHERE status IN ('done', 'failed') AND finished_at >= {NOW} - INTERVAL 24 HOUR)
    SELECT request_id, source, status, 'queued' AS state FROM q WHERE status IN ('pending', 'running') UNION ALL SELECT request_id, source, status, 'recent' FROM r WHERE n <= 20""")
def queue_requests(spark, sf):
    return _snapshot(spark, sf)[1]


def _snapshot(spark, sf):
    events, hour = b.table(spark, sf, "events"), F.expr("interval 2 hours")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    requests = events.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 12).alias("source"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + hour).alias("finished_at"))
    beats = events.groupBy((F.col("user_id") % 5).alias("host")).agg(F.max("ts").alias("at"), F.array_distinct(F.collect_list(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))).alias("running"))
    return queues.snapshot(beats, requests, now(), 24 * 60)


@query(f"""WITH h AS (SELECT user_id % 5 AS host, max(ts) AS moment FROM events GROUP BY 1), f AS (SELECT * FROM h WHERE moment >= {NOW} - INTERVAL 1 DAY)
    SELECT max(moment) AS heartbeat_at, coalesce(max(moment) < {NOW} - INTERVAL 1 DAY, true) AS stale, count(DISTINCT host) AS hosts,
        coalesce((SELECT string_agg(DISTINCT 's' || user_id % 3, ',' ORDER BY 's' || user_id % 3) FROM events WHERE user_id % 5 IN (SELECT host FROM f)), '') AS running FROM f""")
def crawler_state(spark, sf):
    return _snapshot(spark, sf)[0]


FROZEN = evaluation.frozen_settings({"model": "m1", "relevance_threshold": 0.4, "other": 1}, ("model", "relevance_threshold"), {"guide": "what counts", "rules": "b, a"}, "3")


@query()
def context_hashes(spark, sf):
    """A digest a document of what an answer about it depends on."""
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", evaluation.context_hash([F.col("text"), F.col("lang"), F.col("source")], FROZEN).alias("digest"))
