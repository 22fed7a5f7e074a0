"""The engine's named queries and, where SQL has a way to say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import grounding, html, text, tree
from docketry.functions.similarity import partial_of, ratio_of, token_set_of
from docketry.operators import audit, candidates, changes, evaluation, examples, inbox, ladder, linking, monitoring, scoring, statistics
from docketry.operators.inbox import ListQuery
from docketry.session import shared_path, staged
from docketry.sources import files, listings
from docketry.streaming import ingest, state

from . import bindings as b
from .bindings import AS_OF_DATE, AS_OF_TIME, JUDGED, RECORDS, RUNS, SUGGESTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TODAY = f"DATE '{AS_OF_DATE}'"
NOW = f"TIMESTAMP '{AS_OF_TIME}'"
VISIBLE = "is_relevant AND processing_status IN ('READY', 'SUMMARIZED', 'RELEVANT', 'AI_FAILED')"
TRUSTED = "SELECT reg_id FROM sug WHERE is_active AND (origin = 'manual' OR score >= 0.5)"
#: Civil days of Istanbul as instants, three hours ahead in these summers.
DAY_START = "CAST({day} AS TIMESTAMP) - INTERVAL 3 HOUR"


def now():
    return F.lit(AS_OF_TIME).cast("timestamp")


def _listing(where: str, order: str, page: int = 1, size: int = 10, more: str = "") -> str:
    return f"""WITH {RECORDS}, {SUGGESTIONS}, one AS (
        SELECT * FROM rec WHERE {VISIBLE} AND {where} ORDER BY {order}, reg_id DESC LIMIT {size} OFFSET {(page - 1) * size})
    SELECT reg_id, title, issuer, severity, CAST(publish_date AS VARCHAR) AS publish_date, CAST(effective_date AS VARCHAR) AS effective_date,
        review_status,
        CASE WHEN processing_status = 'AI_FAILED' AND ai_attempts >= 3 THEN 'exhausted' WHEN processing_status = 'AI_FAILED' THEN 'failed'
            WHEN processing_status = 'READY' THEN 'complete' ELSE 'running' END AS analysis,
        CASE WHEN effective_date IS NULL THEN 'none' WHEN effective_date = publish_date THEN 'on_publish' ELSE 'date' END AS effective_mode,
        coalesce((SELECT string_agg(rank || ':' || unit, ',' ORDER BY rank, unit) FROM sug WHERE sug.reg_id = one.reg_id AND is_active), '') AS units
    FROM one"""


DEFAULT = "severity DESC, publish_date DESC NULLS LAST"
PRIORITY = f"""round(severity * CASE WHEN effective_date IS NULL THEN 1.0 WHEN effective_date < {TODAY} THEN 1.8
    WHEN effective_date <= {TODAY} + 7 THEN 3.0 WHEN effective_date <= {TODAY} + 30 THEN 2.2 WHEN effective_date <= {TODAY} + 90 THEN 1.4 ELSE 1.0 END
    + CASE WHEN reg_id IN ({TRUSTED}) THEN 0.0 ELSE 0.6 END
    + CASE WHEN detected_at >= {DAY_START.format(day=f"({TODAY} - 1)")} THEN 0.4 ELSE 0.0 END, 4) DESC, detected_at DESC"""


def _list(spark, sf, **criteria):
    return inbox.list_records(b.records(spark, sf), b.suggestions(spark, sf), ListQuery(AS_OF_DATE, **criteria))


@query(_listing("true", DEFAULT))
def inbox_default(spark, sf):
    return _list(spark, sf)


@query(_listing("true", PRIORITY))
def inbox_priority(spark, sf):
    return _list(spark, sf, sort="priority")


@query(_listing("issuer IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2') AND severity IN (3, 4) AND review_status = 'pending'", DEFAULT, size=25))
def inbox_faceted(spark, sf):
    return _list(spark, sf, issuers=("FRANCE", "GERMANY", "NATION_1", "NATION_2"), severities=(3, 4), status="pending", page_size=25)


@query(_listing("contains(lower(translate(title, 'Iı', 'ii')), '12') AND contains(lower(translate(title, 'Iı', 'ii')), 'high')", "title ASC NULLS LAST, publish_date DESC NULLS LAST"))
def inbox_search(spark, sf):
    q = ListQuery(AS_OF_DATE, text="12", sort="title", descending=False)
    rows = inbox.filtered(b.records(spark, sf), b.suggestions(spark, sf), q).where(text.search_fold("title").contains(text.search_fold(F.lit("HIGH"))))
    return inbox.decorated(inbox.page(inbox.ordered(rows, b.suggestions(spark, sf), q), q), b.suggestions(spark, sf), q)


def _summaries(spark, sf):
    """A summary a line of an order, current unless the line was returned."""
    return b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("reg_id"), (F.col("l_returnflag") != "R").alias("is_current"), F.concat(F.lit("PART_"), F.col("l_partkey").cast("string"), F.lit("% İLE")).alias("short_content"))


@query(f"""WITH {RECORDS} SELECT reg_id, title FROM rec WHERE {VISIBLE} AND (contains(lower(translate(title, 'Iı', 'ii')), 'part_17%')
    OR reg_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R' AND contains('part_' || l_partkey || '% ile', 'part_17%')))""")
def inbox_search_summaries(spark, sf):
    """A text with wild cards, in titles and current summaries."""
    return inbox.filtered(b.records(spark, sf), b.suggestions(spark, sf), ListQuery(AS_OF_DATE, text=" Part_17% "), summaries=_summaries(spark, sf)).select("reg_id", "title")


@query(f"""WITH {RECORDS}, {b.LINKS}, {b.HISTORY} SELECT reg_id, issuer FROM rec WHERE {VISIBLE} AND reg_id IN (SELECT reg_id FROM lnk WHERE source IN ('s3', 's7'))
    AND reg_id IN (SELECT reg_id FROM his WHERE kind = 'content_edited') AND reg_id IN ({", ".join(map(str, range(0, 400, 3)))}) AND detected_at < {DAY_START.format(day=f"({TODAY} - 7)")}""")
def inbox_by_ids_and_sources(spark, sf):
    q = ListQuery(AS_OF_DATE, ids=tuple(range(0, 400, 3)), sources=("s3", "s7"), edited=True, detected=("older",))
    return inbox.filtered(b.records(spark, sf), b.suggestions(spark, sf), q, links=b.links(spark, sf), history=b.history(spark, sf)).select("reg_id", "issuer")


@query(_listing("true", DEFAULT, page=5, size=50))
def inbox_page5(spark, sf):
    return _list(spark, sf, page=5, page_size=50)


@query(_listing("reg_id IN (SELECT reg_id FROM sug WHERE is_active AND unit IN (1, 2, 3))", DEFAULT))
def inbox_unit(spark, sf):
    return _list(spark, sf, units=(1, 2, 3))


@query(_listing(f"reg_id NOT IN ({TRUSTED})", DEFAULT, size=20))
def inbox_needs_unit(spark, sf):
    return _list(spark, sf, needs_unit=True, page_size=20)


@query(_listing("reg_id IN (SELECT reg_id FROM sug WHERE (origin = 'manual' AND is_active) OR (origin = 'ai' AND NOT is_active))", DEFAULT))
def inbox_unit_changed(spark, sf):
    return _list(spark, sf, unit_changed=True)


@query(_listing(f"((effective_date BETWEEN {TODAY} AND {TODAY} + 30) OR effective_date IS NULL) AND publish_date >= {TODAY} - 400", "effective_date ASC NULLS LAST, publish_date DESC NULLS LAST", size=30))
def inbox_upcoming_or_open(spark, sf):
    return _list(spark, sf, effective=("30", "none"), days=400, sort="effective_date", descending=False, page_size=30)


@query(_listing("processing_status IN ('SUMMARIZED', 'RELEVANT', 'AI_FAILED')", "(SELECT unit FROM sug WHERE sug.reg_id = rec.reg_id AND is_active ORDER BY rank, unit LIMIT 1) DESC NULLS LAST, publish_date DESC NULLS LAST"))
def inbox_preparing_by_unit(spark, sf):
    return _list(spark, sf, queue="preparing", sort="unit")


FIGURES = f"""count(*) FILTER (WHERE review_status = 'pending') AS pending,
    count(*) FILTER (WHERE review_status = 'pending' AND severity >= 3) AS critical_high,
    count(*) FILTER (WHERE detected_at >= {DAY_START.format(day=TODAY)} AND detected_at < {DAY_START.format(day=f"({TODAY} + 1)")}) AS today,
    count(*) FILTER (WHERE effective_date BETWEEN {TODAY} AND {TODAY} + 30) AS upcoming"""


@query(f"WITH {RECORDS} SELECT {FIGURES} FROM rec WHERE {VISIBLE}")
def stats_metrics(spark, sf):
    return statistics.record_stats(b.records(spark, sf), ListQuery(AS_OF_DATE))


@query(f"""WITH {RECORDS} SELECT severity, count(*) AS waiting,
        count(*) FILTER (WHERE processing_status = 'AI_FAILED' AND ai_attempts >= 3) AS exhausted,
        count(*) FILTER (WHERE processing_status = 'AI_FAILED' AND ai_attempts < 3) AS retryable,
        CAST(date_diff('day', CAST(min(detected_at) AS DATE), {TODAY}) AS BIGINT) AS oldest_days
    FROM rec WHERE {VISIBLE} AND review_status = 'pending' GROUP BY severity""")
def queue_stats(spark, sf):
    return statistics.queue_stats(b.records(spark, sf), ListQuery(AS_OF_DATE))


@query(f"""WITH {RECORDS}, {SUGGESTIONS}, ch AS (SELECT DISTINCT reg_id FROM sug WHERE (origin = 'manual' AND is_active) OR (origin = 'ai' AND NOT is_active)),
    c AS (SELECT count(*) FILTER (WHERE review_status = 'approved') AS approved,
        count(*) FILTER (WHERE review_status = 'approved' AND reg_id IN (SELECT reg_id FROM ch)) AS with_change,
        count(*) FILTER (WHERE review_status = 'rejected') AS rejected FROM rec)
    SELECT *, round(CAST(approved - with_change AS DOUBLE) / nullif(approved, 0), 3) AS unit_accuracy FROM c""")
def decision_stats(spark, sf):
    return statistics.decision_stats(b.records(spark, sf), b.suggestions(spark, sf))


NODES = ["NEW", "RELEVANT", "SUMMARIZED", "READY", "MERGED"]


@query(f"""WITH {RECORDS}, c AS (SELECT processing_status AS node, count(*) AS n, min(detected_at) AS since FROM rec GROUP BY 1),
    k AS (SELECT unnest({NODES}) AS node)
    SELECT node, coalesce(n, 0) AS n, CAST(CAST(since AS DATE) AS VARCHAR) AS oldest FROM k FULL JOIN c USING (node)""")
def pipeline_counts(spark, sf):
    return statistics.pipeline_counts(b.records(spark, sf), NODES)


@query(f"""WITH {RECORDS} SELECT CASE WHEN NOT is_relevant THEN 'irrelevant' WHEN review_status = 'pending' THEN 'open' ELSE review_status END AS tab,
    count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM rec GROUP BY 1""")
def archive_tabs(spark, sf):
    return statistics.archive_tabs(b.records(spark, sf))


@query(f"""WITH {RECORDS} SELECT count(*) FILTER (WHERE review_status = 'pending') AS waiting, {", ".join(f"count(*) FILTER (WHERE review_status <> 'pending' AND {TODAY} - publish_date BETWEEN 0 AND {d}) AS decided_{d}d" for d in (1, 7, 30))} FROM rec WHERE {VISIBLE}""")
def review_flow(spark, sf):
    return statistics.review_flow(b.records(spark, sf), ListQuery(AS_OF_DATE))


@query(f"WITH {RUNS} SELECT task, count(*) AS calls, round(avg(latency), 3) AS mean, round(sum(latency), 2) AS total FROM run GROUP BY task")
def usage_by_type(spark, sf):
    return statistics.usage_by(b.runs(spark, sf), "task", "latency")


BIN = f"CAST(floor((epoch({{t}}) - epoch({NOW} - INTERVAL 24 HOUR)) / 3600) AS INTEGER)"


@query(f"""WITH {RUNS}, h AS (SELECT *, {BIN.format(t="date_trunc('second', started_at)")} AS bin FROM run)
    SELECT CAST(s.bin AS INTEGER) AS bin, count(h.run_id) AS calls, count(*) FILTER (WHERE status = 'failed') AS failed, round(quantile_cont(latency, 0.95), 4) AS p95
    FROM range(24) AS s(bin) LEFT JOIN h ON h.bin = s.bin GROUP BY 1""")
def latency_hourly(spark, sf):
    return monitoring.latency_series(b.runs(spark, sf), now())


@query(f"""WITH {RUNS}, h AS (SELECT *, {BIN.format(t="date_trunc('second', started_at)")} AS bin FROM run)
    SELECT count(*) AS calls, count(*) FILTER (WHERE status = 'failed') AS failed, round(quantile_cont(latency, 0.5), 3) AS p50, round(quantile_cont(latency, 0.95), 3) AS p95
    FROM h WHERE bin BETWEEN 0 AND 23""")
def latency_summary(spark, sf):
    return monitoring.latency_summary(b.runs(spark, sf), now())


@query(f"""WITH {RUNS}, h AS (SELECT *, {BIN.format(t="date_trunc('second', started_at)")} AS bin FROM run)
    SELECT CAST(s.bin AS INTEGER) AS bin, arg_max(latency, (started_at, run_id)) AS value FROM range(24) AS s(bin) LEFT JOIN h ON h.bin = s.bin GROUP BY 1""")
def sample_last_per_hour(spark, sf):
    return monitoring.last_samples(b.runs(spark, sf), now())


@query(f"""WITH {RUNS}, d AS (SELECT CAST(started_at + INTERVAL 3 HOUR AS DATE) AS day, status FROM run),
    s AS (SELECT CAST({NOW} + INTERVAL 3 HOUR AS DATE) - CAST(i AS INTEGER) AS day FROM range(7) AS r(i)),
    c AS (SELECT s.day, count(status) AS total, count(*) FILTER (WHERE status = 'failed') AS failed FROM s LEFT JOIN d USING (day) GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, total, failed, round(100.0 * (total - failed) / nullif(total, 0), 1) AS success FROM c""")
def scan_daily(spark, sf):
    return monitoring.daily_success(b.runs(spark, sf), now())


@query(f"WITH {RUNS} SELECT source, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status FROM run GROUP BY source")
def last_runs(spark, sf):
    return monitoring.last_runs(b.runs(spark, sf))


@query(f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS place FROM run)
    SELECT source, CASE WHEN count(*) >= 3 AND bool_and(status = 'failed') THEN 'down' WHEN bool_or(status = 'failed' AND place = 1) THEN 'delayed' ELSE 'ok' END AS state
    FROM r WHERE place <= 3 GROUP BY source""")
def failed_streak(spark, sf):
    return monitoring.failed_streaks(b.runs(spark, sf))


ARRIVED = f"arrived AS (SELECT source, CAST(started_at AS DATE) AS day, min(started_at) AS came, count(*) AS n FROM run GROUP BY 1, 2 HAVING min(started_at) >= {NOW} - INTERVAL 90 DAY)"


@query(f"WITH {RUNS}, {ARRIVED} SELECT source, CAST(day AS VARCHAR) AS day, n FROM arrived")
def arrivals_having(spark, sf):
    found = monitoring.arrivals(b.runs(spark, sf), now() - F.expr("interval 90 days"))
    return found.select("source", F.col("day").cast("string").alias("day"), "n")


@query(f"""WITH {RUNS}, {ARRIVED}, g AS (SELECT source, CAST(epoch(date_trunc('second', came)) - epoch(date_trunc('second', lag(came) OVER (PARTITION BY source ORDER BY came))) AS BIGINT) AS gap FROM arrived),
    t AS (SELECT source, count(*) FILTER (WHERE gap > 0) AS gaps, floor(quantile_cont(gap, 0.95) FILTER (WHERE gap > 0) + 1e-6) AS p95 FROM g GROUP BY source)
    SELECT source, gaps, round(CASE WHEN gaps >= 8 AND (SELECT floor((epoch({NOW}) - epoch(date_trunc('second', min(started_at)))) / 86400) FROM run WHERE run.source = t.source) >= 28
        THEN greatest(p95 / 3600, 12.0) ELSE 48.0 END, 6) AS tolerance FROM t""")
def gap_tolerance(spark, sf):
    runs = b.runs(spark, sf)
    first = runs.groupBy("source").agg(F.min("started_at").alias("first_at"))
    return monitoring.learned_tolerance(monitoring.arrivals(runs, now() - F.expr("interval 90 days")), 48.0, first_runs=first, now=now())


@query(f"""WITH {RUNS}, w AS (SELECT source, CAST(floor((epoch({NOW}) - epoch(date_trunc('second', started_at)) - 1) / 604800) AS INTEGER) AS week FROM run WHERE started_at < {NOW}),
    f AS (SELECT s.source, k.week, count(w.week) AS n FROM (SELECT DISTINCT source FROM run) s CROSS JOIN range(4) AS k(week) LEFT JOIN w ON w.source = s.source AND w.week = k.week GROUP BY 1, 2),
    t AS (SELECT source, max(n) FILTER (WHERE week = 0) AS current, avg(n) FILTER (WHERE week > 0) AS mean, stddev_pop(n) FILTER (WHERE week > 0) AS sd FROM f GROUP BY source)
    SELECT source, current, round(mean, 2) AS mean, round(sd, 2) AS sd,
        CASE WHEN mean >= 1 AND current < 0.2 * mean THEN 'volume_low' WHEN sd > 0 AND current > mean + 3.0 * sd THEN 'volume_high' ELSE 'usual' END AS state FROM t""")
def weekly_volume(spark, sf):
    return monitoring.weekly_volume(b.runs(spark, sf), now())


def _holidays(spark):
    rows = [("new year", "2024-01-01", "2024-01-01"), ("bridge", "2024-01-11", "2024-01-12")]
    return monitoring.expand_holidays(spark.createDataFrame(rows, "name string, first string, last string").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last")))


@query(f"""WITH s AS (SELECT event_id AS id, date_trunc('second', ts) + INTERVAL 3 HOUR AS s, date_trunc('second', ts) + INTERVAL 75 HOUR AS e FROM events),
    d AS (SELECT id, s, e, unnest(generate_series(CAST(s AS DATE), CAST(e AS DATE), INTERVAL 1 DAY)) AS day FROM s)
    SELECT s.id, round(coalesce(sum((epoch(least(d.e, d.day + INTERVAL 1 DAY)) - epoch(greatest(d.s, d.day))) / 3600), 0), 4) AS business_hours
    FROM s LEFT JOIN d ON s.id = d.id AND isodow(d.day) < 6 AND CAST(d.day AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-11', DATE '2024-01-12') GROUP BY s.id""")
def business_hours(spark, sf):
    spans = b.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("start"), (F.date_trunc("second", "ts") + F.expr("interval 72 hours")).alias("end"))
    return monitoring.business_hours(spans, _holidays(spark))


@query(f"""WITH {RUNS}, r AS (SELECT source, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS ended FROM run)
    SELECT source, count(*) FILTER (WHERE ended = 0) AS streak FROM r GROUP BY source""")
def interrupted_streak(spark, sf):
    return monitoring.interrupted_streak(b.runs(spark, sf))


@query(f"""WITH {RUNS}, a AS (SELECT 'k' || run_id % 40 AS key, started_at AS opened_at, CASE WHEN run_id % 3 <> 0 THEN started_at + INTERVAL 1 DAY END AS resolved_at, run_id % 5 = 0 AS acknowledged FROM run WHERE run_id % 2 = 0),
    f AS (SELECT 'k' || run_id % 50 AS key, max(CAST(run_id % 4 AS INTEGER)) AS severity FROM run WHERE status = 'failed' AND run_id % 50 < 45 GROUP BY 1),
    o AS (SELECT key, min(opened_at) AS opened_at FROM a WHERE resolved_at IS NULL GROUP BY key),
    c AS (SELECT key, max(resolved_at) AS done, arg_max(acknowledged, (resolved_at, acknowledged)) AS ack FROM a WHERE resolved_at IS NOT NULL GROUP BY key)
    SELECT coalesce(f.key, o.key) AS key, severity,
        CASE WHEN f.key IS NULL THEN 'resolved' WHEN o.key IS NOT NULL THEN 'kept' WHEN c.ack AND c.done > {NOW} - INTERVAL 24 HOUR THEN 'snoozed' ELSE 'opened' END AS action
    FROM f FULL JOIN o ON f.key = o.key LEFT JOIN c ON c.key = coalesce(f.key, o.key)""")
def alert_sync(spark, sf):
    runs, i = b.runs(spark, sf), F.col("run_id")
    alerts = runs.where(i % 2 == 0).select(F.concat(F.lit("k"), (i % 40).cast("string")).alias("key"), F.col("started_at").alias("opened_at"), F.when(i % 3 != 0, F.col("started_at") + F.expr("interval 1 day")).alias("resolved_at"), (i % 5 == 0).alias("acknowledged"))
    found = runs.where((F.col("status") == "failed") & (i % 50 < 45)).select(F.concat(F.lit("k"), (i % 50).cast("string")).alias("key"), (i % 4).cast("int").alias("severity"))
    return monitoring.sync_alerts(alerts, found, now())


@query("""WITH s AS (SELECT l_orderkey AS reg_id, bool_or(l_returnflag = 'A') AS g, bool_or(l_returnflag = 'N') AS a, bool_or(l_linestatus = 'F') AS c FROM lineitem GROUP BY 1)
    SELECT reg_id, CASE WHEN g AND NOT a THEN 'gazette_to_agency' ELSE 'agency_to_gazette' END AS direction FROM s WHERE (g AND NOT a) OR (a AND NOT g AND c)""")
def cross_check_two_way(spark, sf):
    flag = F.col("l_returnflag")
    seen = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("reg_id"), F.when(flag == "A", "gazette").when(flag == "N", "agency").otherwise("other").alias("channel"), (F.col("l_linestatus") == "F").alias("claims"))
    return monitoring.cross_check(seen)


@query("SELECT doc_id, sha1(concat_ws('|', coalesce(lang, ''), coalesce(CAST(n_chars AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS fingerprint FROM documents")
def listing_fingerprint(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", changes.listing_fingerprint(F.col("lang"), F.col("n_chars"), F.col("source"), F.col("text")).alias("fingerprint"))


HISTORY = "doc AS (SELECT source, CAST(doc_id % 97 AS BIGINT) AS item, doc_id, md5(text) AS sha FROM documents)"


def _history(spark, sf):
    return b.table(spark, sf, "documents").select("source", (F.col("doc_id") % 97).alias("item"), "doc_id", F.md5("text").alias("sha"))


@query(f"""WITH {HISTORY}, c AS (SELECT *, lag(sha) OVER (PARTITION BY source, item ORDER BY doc_id) AS old FROM doc)
    SELECT source, item, doc_id, sha, row_number() OVER (PARTITION BY source, item ORDER BY doc_id) AS version,
        row_number() OVER (PARTITION BY source, item ORDER BY doc_id DESC) = 1 AS is_latest FROM c WHERE old IS DISTINCT FROM sha""")
def version_history(spark, sf):
    return changes.versions(_history(spark, sf), ["source", "item"], ["doc_id"])


@query(f"WITH {HISTORY} SELECT source, item, max(doc_id) AS doc_id, arg_max(sha, doc_id) AS sha FROM doc GROUP BY source, item")
def latest_version(spark, sf):
    return changes.latest(_history(spark, sf), ["source", "item"], ["doc_id"])


@query(f"""WITH d AS (SELECT source, doc_id % 211 AS external_id, 'c' || doc_id % 3 AS channel, 'u' || doc_id % 7 AS url, md5(text) AS fingerprint, doc_id AS place, doc_id % 2 AS side FROM documents),
    n AS (SELECT source, external_id, max(place) AS place, arg_max(channel, place) AS channel, arg_max(url, place) AS url, arg_max(fingerprint, place) AS fingerprint FROM d WHERE side = 1 GROUP BY 1, 2),
    o AS (SELECT source, external_id, max(place) AS old, arg_max(channel, place) AS channel, arg_max(url, place) AS url, arg_max(fingerprint, place) AS fingerprint FROM d WHERE side = 0 OR place % 5 = 0 GROUP BY 1, 2),
    w AS (SELECT n.source, n.external_id, n.place, CASE WHEN o.channel <> n.channel AND o.url <> n.url THEN 'conflict' WHEN o.fingerprint IS NULL THEN 'new'
        WHEN o.fingerprint <> n.fingerprint THEN 'changed' WHEN old % 60 >= 30 THEN 'refresh' ELSE 'unchanged' END AS wish FROM n LEFT JOIN o USING (source, external_id)),
    r AS (SELECT *, wish IN ('new', 'changed', 'refresh') AS needs, row_number() OVER (PARTITION BY source, wish IN ('new', 'changed', 'refresh') ORDER BY place, external_id) AS turn FROM w)
    SELECT source, external_id, CASE WHEN needs AND turn > 5 THEN 'deferred' ELSE wish END AS action FROM r""")
def upsert_actions(spark, sf):
    i = F.col("doc_id")
    docs = b.table(spark, sf, "documents").select("source", (i % 211).alias("external_id"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("channel"), F.concat(F.lit("u"), (i % 7).cast("string")).alias("url"), F.md5("text").alias("fingerprint"), i.alias("place"))
    listed = changes.latest(docs.where("place % 2 = 1"), ["source", "external_id"], ["place"])
    old = changes.latest(docs.where("place % 2 = 0 or place % 5 = 0"), ["source", "external_id"], ["place"])
    checked = now() - F.make_interval(days=(F.col("place") % 60).cast("int"))
    return changes.upsert_actions(listed, old.withColumn("checked_at", checked), 5, now())


@query("""WITH c AS (SELECT l_orderkey AS run, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'partial' ELSE 'success' END AS status FROM lineitem)
    SELECT run, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'success' END AS status,
        count(*) AS channels, count(*) FILTER (WHERE status = 'failed') AS failed FROM c GROUP BY run""")
def run_rollup(spark, sf):
    flag = F.col("l_returnflag")
    return changes.run_status(b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(flag == "R", "failed").when(flag == "A", "partial").otherwise("success").alias("status")))


@query(f"""WITH {RUNS}, r AS (SELECT run_id, source, started_at, CASE WHEN run_id % 4 = 0 THEN task END AS signature FROM run)
    SELECT run_id, source, last_value(signature IGNORE NULLS) OVER (PARTITION BY source ORDER BY started_at, run_id ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS signature FROM r""")
def stats_carry_forward(spark, sf):
    rows = b.runs(spark, sf).select("run_id", "source", "started_at", F.when(F.col("run_id") % 4 == 0, F.col("task")).alias("signature"))
    return changes.carry_forward(rows, "source", ["started_at", "run_id"], "signature").drop("started_at")


@query(f"""WITH {RUNS}, s AS (SELECT source AS id, CAST(min(started_at) AS DATE) AS first, CAST(max(started_at) AS DATE) + 200 AS last FROM run GROUP BY 1),
    c AS (SELECT id, last, CAST(unnest(generate_series(first, last, INTERVAL 62 DAY)) AS DATE) AS start FROM s)
    SELECT id, CAST(start AS VARCHAR) AS start, CAST(least(start + 61, last) AS VARCHAR) AS stop FROM c""")
def date_chunks(spark, sf):
    spans = b.runs(spark, sf).groupBy(F.col("source").alias("id")).agg(F.to_date(F.min("started_at")).alias("first"), F.date_add(F.to_date(F.max("started_at")), 200).alias("last"))
    return changes.date_chunks(spans)


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 8 = 0 THEN doc_id % 2 = 0 ELSE DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) < DATE '2024-02-01' END AS baseline,
    least(pow(2.0, greatest(doc_id % 9 - 1, 0)), 24.0) AS wait_hours,
    NOT (doc_id % 4 = 0) AND (doc_id % 5 = 0 OR (390 + doc_id % 120 BETWEEN 400 AND 499 AND 390 + doc_id % 120 NOT IN (408, 429))) AS permanent FROM documents""")
def baseline_split(spark, sf):
    i = F.col("doc_id")
    published = F.when(i % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")))
    cutoff = F.when(i % 8 != 0, F.lit("2024-02-01").cast("date"))
    status = F.when(i % 5 != 0, 390 + i % 120)
    return b.table(spark, sf, "documents").select("doc_id", changes.is_baseline(i % 2 == 0, published, cutoff).alias("baseline"), changes.backoff_hours(i % 9).alias("wait_hours"), changes.is_permanent(i % 4 == 0, status).alias("permanent"))


@query("SELECT doc_id, lower(translate(text, 'İIıÇĞÖŞÜ', 'iiiçğöşü')) AS folded, lower(translate(text, 'Iİ', 'ıi')) AS low FROM documents")
def fold_search(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.search_fold("text").alias("folded"), text.tr_lower("text").alias("low"))


@query(r"""SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE 1 - CAST(length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?()\[\]{}''"’“”\-–—/%&+*=<>§|]', '', 'g')) AS DOUBLE) / length(text) END, 6) AS quality FROM documents""")
def text_quality(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.round(text.text_quality("text"), 6).alias("quality"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(translate(t, 'Iİ', 'ıi')), 'âîû’''`´', 'aiu'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key
    FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '^["“”]+|["“”]+$', '', 'g'), '^[\s\-–—−•·]+', ''), '^\d{1,2}[./]\d{1,2}[./]\d{4}\s*', '')) AS t FROM documents)""")
def title_key(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.title_key("text").alias("key"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')
    || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS canonical FROM pages""")
def canonical_url(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.canonical_url("url").alias("canonical"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 583) || '~' || substr(sha1(text), 1, 16) ELSE text END AS key FROM documents")
def key_fit(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.fit_key("text").alias("key"))


@query(f"""WITH m AS (SELECT event_id, CAST(floor((epoch({NOW}) - epoch(date_trunc('second', ts))) / 60) AS BIGINT) AS n FROM events)
    SELECT event_id, CASE WHEN n < 60 THEN greatest(n, 1) || ' dakika önce' WHEN n < 2880 THEN n // 60 || ' saat önce' ELSE n // 1440 || ' gün önce' END AS age FROM m""")
def age_text(spark, sf):
    return b.table(spark, sf, "events").select("event_id", text.age_text("ts", now()).alias("age"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(cell, '^[=+@\\t\\r-]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || text AS cell FROM conversations)")
def csv_neutralize(spark, sf):
    cell = F.concat(F.when(F.col("turn") % 3 == 0, "=").when(F.col("turn") % 3 == 1, "-").otherwise(""), F.col("text"))
    return b.table(spark, sf, "conversations").select("conv_id", "turn", text.neutral_cell(cell).alias("cell"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded FROM documents")
def punctuation_fold(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.punctuation_fold("text").alias("folded"))


@query()
def normal_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", html.normal_text("text").alias("text"))


@query()
def html_text(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", html.html_text("html").alias("text"))


@query()
def page_links(spark, sf):
    links = F.explode(html.page_links("html", "url")).alias("l")
    return b.table(spark, sf, "pages").select("page_id", links).select("page_id", "l.url", "l.title")


@query()
def structure_signature(spark, sf):
    paths = F.array_join(F.array_sort(F.array_distinct(html.structure_paths("html"))), "\n")
    return b.table(spark, sf, "pages").select("page_id", F.substring(F.sha1(paths), 1, 16).alias("signature"))


@query()
def paragraph_chunks(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.posexplode(html.paragraph_chunks("text")).alias("place", "chunk"))


@query("SELECT min(doc_id) AS record, count(*) AS documents, md5(text) AS sha, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_clusters(spark, sf):
    docs = b.table(spark, sf, "documents").withColumn("sha", F.md5("text"))
    same = docs.groupBy("sha").agg(F.min("doc_id").alias("record"), F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return same.where("documents > 1").select("record", "documents", "sha", "sources")


def _publications(spark, sf):
    """Pages as publications with keys; the host is the source."""
    title = text.plain_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int"))
    return b.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url", F.regexp_extract("url", r"^\w+://(?:www\.)?([^/]+)", 1).alias("source"), title.alias("title"), text.match_issuer(title).alias("issuer"), text.guess_type(title).alias("kind"), text.decision_no(title).alias("decision_no"), text.sequence_no(title).alias("sequence_no"), text.title_key(title).alias("title_key"), F.when(F.col("page_id") % 9 != 0, day).alias("day"), F.lit("").alias("text"))


@query()
def document_keys(spark, sf):
    return linking.document_keys(_publications(spark, sf))


def _linked(spark, sf):
    """Publications, their keys, and where each ended up: every fifth comes as a new version of the one ten before."""
    docs = _publications(spark, sf)
    i = F.col("doc_id")
    docs = docs.withColumn("item", F.when((i % 5 == 0) & (i >= 10), i - 10).otherwise(i).cast("string"))
    keys = linking.document_keys(docs)
    never = docs.where(i % 31 == 7).select((i - 7).alias("a"), i.alias("b"))
    # Used twice below, and dear.
    pairs = staged(candidates.fuzzy_candidates(docs), "pairs")
    answers = pairs.where("score < 0.90 AND (a + b) % 3 < 2").select("a", "b", (F.expr("(a + b) % 3") == 0).alias("same"))
    return docs, keys, ladder.link_ladder(docs, keys, pairs, answers, never)


@query()
def linked_records(spark, sf):
    """Every rung: versions, keys, titles of other sources, like titles, answers, and pairs that never join."""
    return _linked(spark, sf)[2]


@query()
def key_conflicts(spark, sf):
    docs, keys, links = _linked(spark, sf)
    return ladder.key_conflicts(keys, links)


@query()
def golden_records(spark, sf):
    docs, _, links = _linked(spark, sf)
    return linking.golden_records(docs, links)


def _titled(spark, sf):
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 28).cast("int"))
    return b.table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("issuer"), day.alias("day"), text.title_key(F.substring_index("text", "\n", 1)).alias("title_key"), F.coalesce("text", F.lit("")).alias("text"))


@query()
def fuzzy_candidates(spark, sf):
    """All pairs of documents by whole first lines and texts."""
    return candidates.fuzzy_candidates(_titled(spark, sf)).select("a", "b", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE p AS (SELECT o_orderkey AS reg_id, CASE o_orderkey WHEN 5 THEN 17 WHEN 6 THEN 20 ELSE o_orderkey // 3 END AS into_id FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey > 2 OR o_orderkey IN (5, 20)),
    walk AS (SELECT reg_id, into_id AS stop, [reg_id, into_id] AS met, reg_id = into_id AS again FROM p
        UNION ALL SELECT walk.reg_id, p.into_id, list_append(met, p.into_id), list_contains(met, p.into_id) FROM walk JOIN p ON p.reg_id = walk.stop WHERE NOT again)
    SELECT reg_id, max_by(stop, len(met)) AS "into" FROM walk GROUP BY reg_id""")
def merge_pointer_closure(spark, sf):
    """Chains, and a circle of 6 and 20 with chains into it."""
    i = F.col("o_orderkey")
    into = F.when(i == 5, 17).when(i == 6, 20).otherwise(F.floor(i / 3))
    return linking.follow_merges(b.table(spark, sf, "orders").where((i % 3 != 2) & (i > 2) | i.isin(5, 20)).select(i.alias("reg_id"), into.alias("into")))


@query("SELECT item_id, doc_id, CAST(position(b.text IN d.text) AS BIGINT) AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact(spark, sf):
    return grounding.exact_quotes(b.table(spark, sf, "benchmark"), b.table(spark, sf, "documents"))


def _altered(words, key):
    """A text's words as somebody may quote them: as they are, in capitals with other marks, with a word in nine left out, or both ends of it."""
    joined = lambda w: F.array_join(w, " ")
    third = F.greatest(F.lit(1), F.floor(F.size(words) / 3).cast("int"))
    ends = F.concat(joined(F.slice(words, 1, third)), F.lit(" [...] "), joined(F.slice(words, F.greatest(F.lit(1), F.size(words) - third + 1), third)))
    marked = F.concat_ws(", ", F.transform(words, lambda w: F.upper(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))))
    dropped = joined(F.filter(words, lambda w, k: k % 9 != 4))
    return F.when(key % 4 == 0, joined(words)).when(key % 4 == 1, marked).when(key % 4 == 2, dropped).otherwise(ends)


@query()
def quote_ladder(spark, sf):
    """Every whole quote of the benchmark, altered, against all documents: one row a quote that any of them has."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return grounding.find_quotes(b.table(spark, sf, "benchmark").select("item_id", _altered(words, F.col("item_id")).alias("quote")), b.table(spark, sf, "documents"))


def _claims(spark, sf):
    """A claim a document that quotes words of its text, altered; eight documents make a record."""
    docs = b.table(spark, sf, "documents").withColumn("record", F.floor(F.col("doc_id") / 8))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return docs.select(F.col("doc_id").alias("item_id"), "record", _altered(F.slice(words, 4, 20), F.col("doc_id")).alias("quote")), docs.select("record", "doc_id", "text")


@query()
def claim_evidence(spark, sf):
    """Each claim's best evidence among all sources of its record."""
    return grounding.quote_evidence(*_claims(spark, sf))


@query()
def similarity_kernels(spark, sf):
    """Neighbouring records' titles by all measures."""
    docs = b.records(spark, sf).select(F.col("reg_id").alias("doc_id"), F.col("title").alias("t"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    t, u = F.col("t"), F.col("u")
    return docs.join(other, "doc_id").select("doc_id", ratio_of(t, u).alias("ratio"), token_set_of(t, u).alias("token_set"), partial_of(t, u).alias("partial"))


@query("""SELECT doc_id, round(0.5 * CASE source WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.2 ELSE 0.3 END
    + 0.5 * least(1.0, (CAST(contains(lower(translate(substr(text, 1, 6000), 'Iİ', 'ıi')), 'the') AS INTEGER) + CAST(contains(lower(translate(substr(text, 1, 6000), 'Iİ', 'ıi')), 'eaux') AS INTEGER)
    + CAST(contains(lower(translate(substr(text, 1, 6000), 'Iİ', 'ıi')), 'ung') AS INTEGER)) / 2.0), 4) AS signal FROM documents""")
def rule_signal(spark, sf):
    priority = F.when(F.col("source") == "src1", 0.9).when(F.col("source") == "src2", 0.2).otherwise(0.3)
    return b.table(spark, sf, "documents").select("doc_id", scoring.rule_signal(priority, F.col("text"), ["the", "eaux", "ung"]).alias("signal"))


@query("""WITH v AS (SELECT doc_id AS record, k, (doc_id + k) % 3 <> 0 AS relevant, least(1.0, greatest(0.0, ((doc_id * 13 + k * 7) % 120 - 10) / 100.0)) AS score, (doc_id + k) % 7 = 0 AS uncertain, (doc_id % 10) / 10.0 AS rules, n_chars > 300 AS has_text FROM documents, range(3) AS r(k)),
    o AS (SELECT record, avg(score) AS model, avg(CAST(relevant AS INTEGER)) AS ratio, 2 * count(*) FILTER (WHERE uncertain) >= count(*) AND bool_or(uncertain) AS doubt, max(rules) AS rules, bool_or(has_text) AS has_text FROM v GROUP BY 1),
    s AS (SELECT *, round(0.6 * model + 0.3 * ratio + 0.1 * rules, 4) AS total, ratio > 0 AND ratio < 1 AS split FROM o)
    SELECT record, total AS score, total >= 0.4 OR doubt OR split OR (NOT has_text AND total >= 0.2) AS relevant, doubt OR split OR NOT has_text AS uncertain,
        CASE WHEN doubt OR split OR NOT has_text THEN 'low' WHEN total >= 0.75 THEN 'high' WHEN total >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM s""")
def ensemble_decision(spark, sf):
    i, k = F.col("doc_id"), F.col("k")
    votes = b.table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("k"))
    return scoring.ensemble(votes.select(i.alias("record"), ((i + k) % 3 != 0).alias("relevant"), (((i * 13 + k * 7) % 120 - 10) / 100.0).alias("score"), ((i + k) % 7 == 0).alias("uncertain"), ((i % 10) / 10.0).alias("rules"), (F.col("n_chars") > 300).alias("has_text")))


SEVERITY_RULES = scoring.SeverityRules(critical=("the on",), immediate=("of the",), addressed=("reth",), cap_by_type={"de": 1}, cap_by_title={"^the": 2})


@query(r"""WITH d AS (SELECT doc_id, lang, CAST(doc_id % 5 AS INTEGER) AS s, lower(translate(text, 'Iİ', 'ıi')) AS low, lower(translate(split_part(text, chr(10), 1), 'Iİ', 'ıi')) AS head FROM documents),
    r AS (SELECT *, CASE WHEN regexp_matches(low, 'the\s+on') OR (regexp_matches(low, 'of\s+the') AND regexp_matches(low, '\breth\b')) THEN greatest(s, 3) ELSE s END AS raised FROM d)
    SELECT doc_id, least(raised, CASE WHEN lang = 'de' THEN 1 END, CASE WHEN regexp_matches(head, '^the') THEN 2 END) AS severity FROM r""")
def severity_caps(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", scoring.ruled_severity((F.col("doc_id") % 5).cast("int"), F.col("lang"), F.col("text"), F.substring_index("text", "\n", 1), SEVERITY_RULES).alias("severity"))


@query()
def stem_keywords(spark, sf):
    return scoring.keyword_units(b.table(spark, sf, "documents"), {"u1": ["the on", "thing"], "u2": ["reaux le"], "u3": ["chung der", "thing", "eninge"]})


def _examples(spark, sf):
    """Titles of documents, and those of pages as examples of past decisions, each third one corrected."""
    texts = b.table(spark, sf, "documents").select(F.col("doc_id").alias("record"), text.title_key(F.substring_index("text", "\n", 1)).alias("text"))
    title = text.plain_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    i = F.col("page_id")
    return texts, b.table(spark, sf, "pages").select(i.alias("example"), text.title_key(title).alias("text"), F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("weight"))


@query()
def nearest_examples(spark, sf):
    """The five examples of each record that are most like its title, corrected ones counting double."""
    return examples.nearest(*_examples(spark, sf), 5)


@query()
def suggestion_gate(spark, sf):
    """Suggested units of parts by brand, against two duties a unit."""
    parts, i = b.table(spark, sf, "part"), F.col("p_partkey")
    raw = parts.select(i.alias("record"), (i % 6).alias("unit"), (i % 10 / 10).alias("score"), F.col("p_name").alias("claim"), F.array((i % 3).cast("string")).alias("areas"))
    raw = raw.union(parts.select(i, (i * 7 % 6), (i % 9 / 10), F.col("p_type"), F.array()))
    duties = spark.createDataFrame([(u, d, a) for u in range(6) for d, a in ((f"small ring {u}", [str(u % 3)]), ("economy", [str(u % 3)]))], "unit long, duty string, unit_areas array<string>")
    return scoring.gated_suggestions(raw, duties)


DECIDE = "(coalesce(score, 0) >= {t} OR uncertain OR (NOT has_text AND coalesce(score, 0) >= {t} / 2))"
CONFUSION = "count(*) FILTER (WHERE {p} AND expected) AS tp, count(*) FILTER (WHERE {p} AND NOT expected) AS fp, count(*) FILTER (WHERE NOT {p} AND expected) AS fn, count(*) FILTER (WHERE NOT {p} AND NOT expected) AS tn"


@query(f"""WITH {JUDGED}, t AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6])::DOUBLE AS threshold),
    c AS (SELECT threshold, {CONFUSION.format(p=DECIDE.format(t="threshold"))} FROM item, t WHERE expected IS NOT NULL GROUP BY threshold),
    m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1.0) AS r, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0) AS p FROM c)
    SELECT threshold, tp, fp, fn, tn, round(r, 3) AS recall, round(p, 3) AS precision, round(coalesce(2 * r * p / nullif(r + p, 0), 0), 3) AS f1 FROM m""")
def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(b.judged(spark, sf))


@query(f"WITH {JUDGED} SELECT count(*) AS n, round(avg(CAST(severity = severity_expected AS INTEGER)), 3) AS exact, round(avg(CAST(abs(severity - severity_expected) <= 1 AS INTEGER)), 3) AS near FROM item")
def ordinal_accuracy(spark, sf):
    return evaluation.ordinal_accuracy(b.judged(spark, sf))


SIDES = "side AS (SELECT *, 'A' AS side, a AS result FROM item UNION ALL SELECT *, 'B' AS side, b AS result FROM item)"


@query(f"""WITH {JUDGED}, {SIDES}, c AS (SELECT side, {CONFUSION.format(p="result")} FROM side WHERE result IS NOT NULL AND expected IS NOT NULL GROUP BY side)
    SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 3) AS recall, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 3) AS precision FROM c""")
def confusion(spark, sf):
    return evaluation.side_metrics(b.judged(spark, sf))


@query(f"""WITH {JUDGED}, {SIDES}, c AS (SELECT stratum, side, count(*) AS total, count(result) AS n, count(*) FILTER (WHERE result) AS relevant,
        count(*) FILTER (WHERE NOT a AND b) AS gained, count(*) FILTER (WHERE a AND NOT b) AS lost FROM side GROUP BY 1, 2),
    p AS (SELECT *, CAST(relevant AS DOUBLE) / n AS p, 3.8416 AS zz FROM c)
    SELECT stratum, side, total, n, relevant, gained, lost, round(p, 3) AS rate,
        round(greatest(0.0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS low,
        round(least(1.0, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS high FROM p""")
def strata_wilson(spark, sf):
    return evaluation.strata_summary(b.judged(spark, sf))


@query(f"""WITH {JUDGED}, c AS (SELECT count(*) FILTER (WHERE a = expected AND b <> expected) AS a_only, count(*) FILTER (WHERE a <> expected AND b = expected) AS b_only FROM item WHERE a IS NOT NULL AND b IS NOT NULL AND expected IS NOT NULL)
    SELECT a_only, b_only, round(least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))) FROM range(least(a_only, b_only) + 1) AS r(i))), 4) AS p FROM c""")
def mcnemar(spark, sf):
    return evaluation.significance(b.judged(spark, sf))


@query(f"""WITH {JUDGED}, {SIDES}, w AS (SELECT *, CASE stratum WHEN 's1' THEN 5000.0 WHEN 's3' THEN 900.0 END / count(*) OVER (PARTITION BY side, stratum) AS weight FROM side WHERE result IS NOT NULL AND expected IS NOT NULL)
    SELECT side, round(sum(coalesce(weight, 1.0) * CAST(expected AS INTEGER)) / sum(coalesce(weight, 1.0)), 3) AS precision FROM w WHERE result GROUP BY side""")
def weighted_precision(spark, sf):
    return evaluation.weighted_precision(b.judged(spark, sf), spark.createDataFrame([("s1", 5000.0), ("s3", 900.0)], "stratum string, population double"))


@query(f"WITH {JUDGED}, d AS (SELECT {DECIDE.format(t=0.4)} AS was, {DECIDE.format(t=0.6)} AS will FROM item) SELECT count(*) FILTER (WHERE was) AS before, count(*) FILTER (WHERE will) AS after, count(*) FILTER (WHERE NOT was AND will) AS gained, count(*) FILTER (WHERE was AND NOT will) AS lost FROM d")
def what_if(spark, sf):
    return evaluation.what_if(b.judged(spark, sf), 0.4, 0.6)


@query(f"WITH {JUDGED}, r AS (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || doc_id), doc_id) AS place FROM item) SELECT * FROM r WHERE place <= 20")
def stratified_sample(spark, sf):
    return evaluation.stratified_sample(b.judged(spark, sf), 20, "7")


@query(f"""WITH {JUDGED}, c AS (SELECT source, count(*) FILTER (WHERE expected) AS expected, count(*) FILTER (WHERE expected AND a) AS found, count(*) FILTER (WHERE expected AND NOT coalesce(a, false)) AS missed, count(*) FILTER (WHERE NOT expected AND a) AS extra FROM item GROUP BY 1)
    SELECT *, round(CAST(found AS DOUBLE) / nullif(expected, 0), 3) AS recall, round(CAST(found AS DOUBLE) / nullif(found + extra, 0), 3) AS precision FROM c""")
def list_comparison(spark, sf):
    return evaluation.issuer_summary(b.judged(spark, sf), "source")


def _events(spark, sf):
    return b.table(spark, sf, "conversations").select(F.col("conv_id").alias("record"), F.col("turn").alias("place"), F.concat_ws("/", "role", "text").alias("payload"))


CHAIN = """WITH RECURSIVE e AS (SELECT conv_id AS record, turn AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || '/' || text) AS k, role || '/' || text AS payload FROM conversations),
    c AS (SELECT record, place, k, payload, CAST(NULL AS VARCHAR) AS prev_hash, sha256(payload || '|') AS row_hash FROM e WHERE k = 1
        UNION ALL SELECT e.record, e.place, e.k, e.payload, c.row_hash, sha256(e.payload || '|' || c.row_hash) FROM c JOIN e ON e.record = c.record AND e.k = c.k + 1)
    SELECT record, place, payload, prev_hash, row_hash FROM c"""


@query(CHAIN)
def audit_chain(spark, sf):
    return audit.build_chain(_events(spark, sf))


@query(CHAIN)
def audit_append(spark, sf):
    """The same in three batches, each going on from the chain that is stored by then."""
    events, path = _events(spark, sf), shared_path(spark, "chain")
    for n, turns in enumerate(("place < 2", "place between 2 and 3", "place > 3")):
        stored = audit.heads(spark.read.parquet(path)) if n else None
        audit.append_chain(events.where(turns), stored).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT conv_id AS record, turn AS place, 'changed content' AS problem FROM conversations
    WHERE (conv_id * 31 + turn) % 50 = 7""")
def audit_chain_verify(spark, sf):
    """The chain after some contents were changed behind its back."""
    chained = audit.build_chain(_events(spark, sf))
    hurt = (F.col("record") * 31 + F.col("place")) % 50 == 7
    return audit.verify_chain(chained.withColumn("payload", F.when(hurt, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY user_id")
def stream_ingest_replay(spark, sf):
    """Events as revisions of their users, replayed through a stream into the archive; its final state."""
    path = shared_path(spark, "ingest")
    stream = ingest.source(spark, f"{sf}/events*.parquet", EVENTS)
    ingest.ingest(stream, path, f"{path}-log", lambda x: x.select("user_id", "event_id", "event_type", "value")).awaitTermination()
    return ingest.current(spark, path, ["user_id"], ["event_id"]).withColumn("value", F.round("value", 4))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_windows(spark, sf):
    stream = ingest.source(spark, f"{sf}/events*.parquet", EVENTS)
    return ingest.run_to_parquet(ingest.windowed(stream, "ts", "event_type"), spark, "windows").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH b AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id // 2 END AS parent FROM events WHERE event_id % 5 <> 1)
    SELECT id, parent, parent IS NULL OR parent IN (SELECT id FROM b) AS ready FROM b""")
def late_children(spark, sf):
    i = F.col("event_id")
    batch = b.table(spark, sf, "events").where(i % 5 != 1).select(i.alias("id"), F.when(i % 3 == 0, F.floor(i / 2)).alias("parent"))
    ready, waiting = ingest.ready_and_deferred(batch, batch.limit(0))
    return ready.withColumn("ready", F.lit(True)).unionByName(waiting.withColumn("ready", F.lit(False)))


def _as_stream(spark, rows, name, files=3):
    """Rows (with ``file`` from 0) written as files that a stream takes one by one."""
    path = shared_path(spark, name)
    for n in range(files):
        rows.where(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(path)
    return ingest.source(spark, path, rows.drop("file").schema, 1)


def _families(spark, sf):
    """Documents as attachments of every third one, which mostly come after them; some name a parent that doesn't exist."""
    i = F.col("doc_id")
    parent = F.when(i % 3 != 0, F.when(i % 17 == 0, -i).otherwise(i - i % 3))
    at = F.lit(AS_OF_TIME).cast("timestamp") + F.make_interval(mins=(i % 1000).cast("int"))
    return b.table(spark, sf, "documents").select(i.alias("id"), parent.alias("parent"), at.alias("at"), F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(3)).alias("file"))


@query("""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 17 = 0 THEN -doc_id ELSE doc_id - doc_id % 3 END END AS parent FROM documents)
    SELECT id, parent, 'ready' AS state FROM d WHERE parent IS NULL OR parent IN (SELECT id FROM d WHERE parent IS NULL)""")
def stream_late_children(spark, sf):
    """Three batches; children that come before their parents wait in state and go on with them."""
    stream = state.with_parents(_as_stream(spark, _families(spark, sf), "families"), timedelta(days=30), "10 days")
    return state.replayed(stream, spark, "late-children")


def _observations(spark, sf):
    kind = F.when(F.col("task") == "purchase", "ack").when(F.col("task").isin("error", "click"), "found")
    seen = b.runs(spark, sf).select(F.concat(F.lit("k"), F.col("source").cast("string")).alias("key"), F.date_trunc("second", "started_at").alias("at"), kind.alias("kind"), (F.col("run_id") % 4).cast("int").alias("severity"), F.pmod("run_id", F.lit(3)).cast("int").alias("file"))
    return seen.where("kind is not null")


@query()
def stream_alerts(spark, sf):
    """Failed and partial runs as findings, in three batches that are out of order: openings, resolutions and what is slept over."""
    stream = state.alert_lifecycle(_as_stream(spark, _observations(spark, sf), "observations"), timedelta(hours=2), timedelta(hours=24), "60 days")
    return state.replayed(stream, spark, "alerts")


@query("SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^(.*\\.org|www\\..*)$') AS allowed FROM pages")
def host_allow_list(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", listings.host_allowed(F.col("url"), ["*.org", "www.*"]).alias("allowed"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')""")
def json_listing(spark, sf):
    bodies = b.table(spark, sf, "events").select(F.concat(F.lit('{"data": {"items": [{"id": '), F.col("event_id").cast("string"), F.lit(', "p": '), F.col("props"), F.lit("}]}}")).alias("body"))
    found = listings.json_items(bodies, listings.JsonListing("data.items", {"event_id": "id", "k": "p.k"}, allow={"k": ("1", "2", "3")}))
    return found.select(F.col("event_id").cast("long").alias("event_id"), "k")


@query()
def link_listing(spark, sf):
    return listings.link_items(b.table(spark, sf, "pages"), r"https?://[^/]+/([^?#]+)", r"\.(?:css|js|png)$")


MENU = tree.CssListing("nav > ul > li", frame=True)


@query(r"""WITH m AS (SELECT page_id, url AS base, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
    l AS (SELECT page_id, base, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS title, generate_subscripts(regexp_extract_all(nav, '<li><a href="([^"]*)">', 1), 1) - 1 AS place FROM m),
    u AS (SELECT page_id, place, regexp_extract(base, '^(\w+://[^/?#]*)', 1) || href AS url, trim(title, ' –-—') AS title FROM l),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY place) AS turn FROM u)
    SELECT page_id, CAST(place AS INTEGER) AS place, url, title FROM o WHERE turn = 1""")
def css_listing(spark, sf):
    """The menus of pages as listings."""
    return listings.selected_items(b.table(spark, sf, "pages"), MENU).select("page_id", "place", "url", "title")


@query()
def css_fields(spark, sf):
    """Every third link of a menu, its title from the whole menu where it says nothing, with fields by patterns."""
    rules = listings.ItemRules(date=r"\d{4}-\d{2}-\d{2}", fields={"first": r"^\S+", "letters": r"[^\W\d_]+"}, strip=(r"[.,]+$",), prefix="M: ", id_pattern=r"//[^/]+/(.*)", id_prefix="menu:")
    return listings.selected_items(b.table(spark, sf, "pages"), tree.CssListing("li:nth-child(3n+1) a[href^='/'], footer a", frame=True, around=True), rules)


def _issues(spark, sf):
    """Index pages of a gazette made of the orders: an issue a day, one supplement where there are several orders, sections by priority."""
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2).cast("int").alias("supplement"), F.substring("o_orderpriority", 3, 20).alias("name"))
    issue = F.concat(F.date_format("day", "yyyyMMdd"), F.when(F.col("supplement") > 0, "M1").otherwise(""))
    section = F.when(F.col("name") == "LOW", "İlân  Bölümü").otherwise(F.col("name"))
    item = F.concat(F.lit("<div class='html-title'>"), section, F.lit("</div>"), F.when(F.col("k") % 3 == 0, "<p class='html-subtitle'>Sub</p>").otherwise(""), F.lit("<div class='fihrist-item x'>– <a href='/eskiler/2001/01/"), issue, F.lit("-"), F.col("k").cast("string"), F.lit(".htm'>Order "), F.col("k").cast("string"), F.lit("</a></div>"))
    html = F.concat(F.lit("<div id=html-content>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("h")))), lambda x: x["h"]), "<div class=fihrist-item><a href=/other/19000101-1.htm>of another day</a></div>"), F.lit("</div>"))
    pages = orders.groupBy("day", "supplement").agg(html.alias("html"))
    return pages.withColumn("url", F.lit("https://g.example/fihrist"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 AS sup, substr(o_orderpriority, 3, 20) AS name FROM orders)
    SELECT strftime(day, '%Y%m%d') || CASE WHEN sup > 0 THEN 'M1' ELSE '' END AS issue, 'Order ' || k AS title, strftime(day, '%Y%m%d') || CASE WHEN sup > 0 THEN 'M1' ELSE '' END || '-' || k AS external_id,
        CASE WHEN k % 3 = 0 THEN 'Sub' ELSE name END AS category FROM o WHERE name <> 'LOW'""")
def gazette_index(spark, sf):
    """Texts of all issues, with their sections, but the notices."""
    return listings.gazette_items(_issues(spark, sf)).select("issue", "title", "external_id", "category")


@query()
def main_content(spark, sf):
    """The content of every page by its tree: letters outside of menus, advertisements and footers."""
    found = tree.content_of(F.col("html")).alias("c")
    return b.table(spark, sf, "pages").select("page_id", found).select("page_id", "c.method", F.length("c.text").alias("n_chars"), F.md5("c.text").alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def blob_store(spark, sf):
    """Every text stored once under its digest, and the key of each document."""
    return files.store_blobs(b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), shared_path(spark, "blobs"))


@query(f"""WITH {RECORDS} SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT '  ' || processing_status || '["' || processing_status || ' (' || count(*) || ')"]' AS line FROM rec GROUP BY processing_status)""")
def pipeline_chart(spark, sf):
    nodes = b.records(spark, sf).groupBy(F.col("processing_status").alias("id")).agg(F.count("*").alias("n")).withColumn("label", F.col("id"))
    return files.mermaid(nodes, spark.createDataFrame([], "a string, b string, label string"))


@query("""WITH c AS (SELECT text, min(event_id) AS first FROM (SELECT event_type || '/' || user_id AS text, event_id FROM events) GROUP BY text) SELECT text, first FROM c""")
def request_cache(spark, sf):
    """Each distinct request is answered once, by its first call."""
    text_of = F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("text")
    return b.table(spark, sf, "events").select(text_of, "event_id").groupBy("text").agg(F.min("event_id").alias("first"))


@query()
def title_facts(spark, sf):
    """All that is read from a title, for the pages' titles."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    facts = {"kind": text.guess_type(title), "amends": text.is_amendment(title), "amended": text.amended_title(title), "decision": text.decision_no(title), "sequence": text.sequence_no(title), "issuer": text.match_issuer(title), "day": text.parse_date(title).cast("string")}
    return b.table(spark, sf, "pages").select("page_id", *[v.alias(k) for k, v in facts.items()])


@query()
def effective_clauses(spark, sf):
    found = b.table(spark, sf, "documents").select("doc_id", text.effective_clause("text", F.lit(AS_OF_DATE).cast("date")).alias("c"))
    return found.select("doc_id", "c.clause", F.col("c.value").cast("string").alias("day"), "c.basis")
