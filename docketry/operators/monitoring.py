"""Health of sources over their runs and arrivals: series, gaps, volume, streaks and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import percentiles


def _seconds(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def hour_bins(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Add ``bin``: whole hours since ``hours`` before now; bins are anchored at now and not at clock hours."""
    bins = F.floor(_seconds(F.col(at), now - F.expr(f"interval {hours} hours")) / 3600).cast("int")
    return rows.withColumn("bin", bins).where(F.col("bin").between(0, hours - 1))


def _spine(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))


def latency_series(calls: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Calls, failures and the 95th percentile of each hour, null for hours without calls."""
    inside = hour_bins(calls, "started_at", now, hours)
    binned = inside.groupBy("bin").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))
    binned = binned.join(percentiles(inside, ["bin"], "latency", {"p95": 0.95}), "bin", "left").withColumn("p95", F.round("p95", 4))
    return _spine(calls, hours).join(binned, "bin", "left").select("bin", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"), "p95")


def latency_summary(calls: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    inside = hour_bins(calls, "started_at", now, hours)
    counts = inside.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))
    found = percentiles(inside, [], "latency", {"p50": 0.5, "p95": 0.95})
    # One row each, also where there is no call.
    return counts.join(found, F.lit(True), "left").select("calls", "failed", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


def last_samples(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest value of each hour, null where there is none."""
    last = F.max(F.struct("started_at", "run_id", "latency"))["latency"]
    return _spine(rows, hours).join(hour_bins(rows, "started_at", now, hours).groupBy("bin").agg(last.alias("value")), "bin", "left")


def daily_success(runs: DataFrame, now: Column, days: int = 7, zone: str = "Europe/Istanbul") -> DataFrame:
    """Of each civil day: runs, failed runs and the share that succeeded, null without runs."""
    day = F.to_date(F.from_utc_timestamp("started_at", zone))
    today = F.to_date(F.from_utc_timestamp(now, zone))
    spine = runs.sparkSession.range(days).select(F.date_sub(today, (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    counts = runs.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    joined = F.broadcast(spine).join(counts, "day", "left")  # a row a day
    total, failed = F.coalesce("total", F.lit(0)), F.coalesce("failed", F.lit(0))
    return joined.select(F.col("day").cast("string").alias("day"), total.alias("total"), failed.alias("failed"), F.round(F.try_divide(100.0 * (total - failed), total), 1).alias("success"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source."""
    newest = F.max(F.struct("started_at", "run_id", "status"))
    return runs.groupBy("source").agg(newest.alias("r")).select("source", F.col("r.run_id").alias("run_id"), F.col("r.status").alias("status"))


def failed_streaks(runs: DataFrame, n: int = 3) -> DataFrame:
    """down if a source's newest ``n`` runs failed, delayed if the newest did, else ok."""
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id"))
    ranked = runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)
    failed = F.col("status") == "failed"
    state = F.when((F.count("*") >= n) & F.bool_and(failed), "down").when(F.bool_or(failed & (F.col("place") == 1)), "delayed").otherwise("ok")
    return ranked.groupBy("source").agg(state.alias("state"))


def arrivals(runs: DataFrame, since: Column) -> DataFrame:
    """The first arrival of each source and civil day, of those since a time."""
    return runs.groupBy("source", F.to_date("started_at").alias("day")).agg(F.min("started_at").alias("at"), F.count("*").alias("n")).where(F.col("at") >= since)


def learned_tolerance(arrived: DataFrame, configured: float, least_gaps: int = 8, floor_hours: float = 12.0, first_runs: DataFrame | None = None, now: Column | None = None, least_days: int = 28, in_business_hours: DataFrame | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """The 95th percentile of a source's gaps in hours, not under the floor; with few gaps or a short history the configured one.

    ``first_runs`` (source, first_at): with it a source counts as known from
    ``least_days`` whole days before ``now``.  Gaps are whole seconds, and hours
    are rounded once, at the end.  Gaps of the sources ``in_business_hours``
    (source) count hours of business days alone, without ``holidays`` (day).
    """
    # A row a source and day: a window over few.
    before = F.lag("at").over(Window.partitionBy("source").orderBy("at"))
    gaps = arrived.withColumn("before", before).withColumn("gap", _seconds(F.col("at"), F.col("before")))
    if in_business_hours is not None:
        gaps = elapsed_hours(gaps, in_business_hours, holidays).withColumn("gap", F.round(F.col("hours") * 3600).cast("long"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    found = gaps.groupBy("source").agg(F.count(positive).alias("gaps"))
    ranked = percentiles(gaps.select("source", positive.alias("gap")), ["source"], "gap", {"p95": 0.95})
    found = found.join(ranked, "source", "left").withColumn("p95", F.floor(F.col("p95") + 1e-6))
    enough = F.col("gaps") >= least_gaps
    if first_runs is not None:
        found = found.join(first_runs, "source", "left")
        enough = enough & (F.floor(_seconds(now, F.col("first_at")) / 86400) >= least_days)
    tolerance = F.when(enough, F.greatest(F.col("p95") / 3600, F.lit(floor_hours))).otherwise(F.lit(configured))
    return found.select("source", "gaps", F.round(tolerance, 6).alias("tolerance"))


def weekly_volume(rows: DataFrame, now: Column, weeks: int = 3, low: float = 0.2, sigmas: float = 3.0) -> DataFrame:
    """The last seven days' rows of each source against the weeks before, counted back from now."""
    # now itself is outside: weeks are half open, [start, end).
    weekly = rows.where(F.col("started_at") < now).withColumn("week", F.floor((_seconds(now, F.col("started_at")) - 1) / (7 * 86400)).cast("int"))
    weekly = weekly.where(F.col("week") <= weeks).groupBy("source", "week").agg(F.count("*").alias("n"))
    spine = rows.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(weeks))).alias("week"))
    full = spine.join(weekly, ["source", "week"], "left").select("source", "week", F.coalesce("n", F.lit(0)).alias("n"))
    past = F.when(F.col("week") > 0, F.col("n"))
    stats = full.groupBy("source").agg(F.max(F.when(F.col("week") == 0, F.col("n"))).alias("current"), F.avg(past).alias("mean"), F.stddev_pop(past).alias("sd"))
    state = F.when((F.col("mean") >= 1) & (F.col("current") < low * F.col("mean")), "volume_low")
    state = state.when((F.col("sd") > 0) & (F.col("current") > F.col("mean") + sigmas * F.col("sd")), "volume_high").otherwise("usual")
    return stats.select("source", "current", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), state.alias("state"))


def is_business_day(day: Column, holidays: DataFrame | None = None) -> Column:
    """Monday to Friday; holidays are taken out by an anti join on the day."""
    return F.weekday(day) < 5


def expand_holidays(ranges: DataFrame) -> DataFrame:
    """Rows (name, first, last) as one row a day."""
    return ranges.select("name", F.explode(F.sequence("first", "last")).alias("day")).dropDuplicates(["day"])


def business_hours(spans: DataFrame, holidays: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    """Add ``business_hours`` to rows (id, start, end): hours within business days of a zone, whole days counted."""
    local = spans.select("id", F.from_utc_timestamp("start", zone).alias("s"), F.from_utc_timestamp("end", zone).alias("e"))
    days = local.where("e > s").select("*", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))).alias("day"))
    days = days.where(F.weekday("day") < 5).join(F.broadcast(holidays.select("day")), "day", "left_anti")  # a few days a year
    low, high = F.greatest("s", F.col("day").cast("timestamp")), F.least("e", F.date_add("day", 1).cast("timestamp"))
    hours = days.groupBy("id").agg(F.sum(_seconds(high, low) / 3600).alias("h"))
    return spans.select("id").join(hours, "id", "left").select("id", F.round(F.coalesce("h", F.lit(0.0)), 4).alias("business_hours"))


def elapsed_hours(spans: DataFrame, in_business_hours: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Spans (source, before, at) with ``hours``: of business days for the sources named, by the clock for all others."""
    days = spans.sparkSession.createDataFrame([], "day date") if holidays is None else holidays
    named = in_business_hours.select("source", F.lit(True).alias("_business")).distinct()
    both = spans.join(named, "source", "left")
    key = F.struct("source", "before", "at")
    own = both.where(F.col("_business") & F.col("before").isNotNull()).select(key.alias("id"), F.col("before").alias("start"), F.col("at").alias("end")).distinct()
    worked = business_hours(own, days).select(F.col("id.source").alias("source"), F.col("id.before").alias("before"), F.col("id.at").alias("at"), "business_hours")
    found = both.join(worked, ["source", "before", "at"], "left")
    return found.withColumn("hours", F.when(F.col("_business"), F.col("business_hours")).otherwise(_seconds(F.col("at"), F.col("before")) / 3600)).drop("_business", "business_hours")


def interrupted_streak(jobs: DataFrame) -> DataFrame:
    """How many of a source's newest runs in a row aren't successes."""
    at = F.struct("started_at", "run_id")
    newest = jobs.groupBy("source").agg(F.max(F.when(F.col("status") == "success", at)).alias("good"))
    later = jobs.join(newest, "source").groupBy("source").agg(F.count_if(F.col("good").isNull() | (at > F.col("good"))).alias("streak"))
    return later


@dataclass(frozen=True)
class AlertRules:
    snooze_hours: int = 24


# The tab where an alert is dealt with.
ALERT_TABS = {t: "kaynaklar" for t in ("fetch_error", "structure_change", "volume_low", "volume_high", "crawler_down", "ingest_lag", "crawl_request", "cross_check_miss")}


def alert_tab(kind: Column) -> Column:
    return F.when(kind.isin(*ALERT_TABS), "kaynaklar").otherwise("genel")


def sync_alerts(alerts: DataFrame, findings: DataFrame, now: Column, rules: AlertRules = AlertRules()) -> DataFrame:
    """What becomes of each key: opened, kept, resolved or snoozed.

    ``alerts``: key, opened_at, resolved_at, acknowledged; ``findings``: key,
    severity.  A key whose newest closed alert was acknowledged isn't opened
    again for a while.
    """
    opened = alerts.where("resolved_at is null").groupBy("key").agg(F.min("opened_at").alias("opened_at"))
    closed = alerts.where("resolved_at is not null").groupBy("key").agg(F.max(F.struct("resolved_at", "acknowledged")).alias("c"))
    recent = F.col("c.resolved_at") > now - F.expr(f"interval {rules.snooze_hours} hours")
    asleep = closed.where(F.col("c.acknowledged") & recent).select("key", F.lit(True).alias("asleep"))
    found = findings.groupBy("key").agg(F.max("severity").alias("severity"))
    both = found.join(opened, "key", "full").join(asleep, "key", "left")
    action = F.when(F.col("severity").isNull(), "resolved").when(F.col("opened_at").isNotNull(), "kept").when(F.col("asleep"), "snoozed").otherwise("opened")
    return both.select("key", "severity", action.alias("action"))


def cross_check(published: DataFrame) -> DataFrame:
    """Records that one of two channels has and the other hasn't.

    ``published``: reg_id, channel (gazette or agency), claims (whether an
    agency's copy says that the gazette has it).
    """
    seen = published.groupBy("reg_id").agg(F.bool_or(F.col("channel") == "gazette").alias("gazette"), F.bool_or(F.col("channel") == "agency").alias("agency"), F.bool_or("claims").alias("claims"))
    missing = F.when(F.col("gazette") & ~F.col("agency"), "gazette_to_agency").when(F.col("agency") & ~F.col("gazette") & F.col("claims"), "agency_to_gazette")
    return seen.select("reg_id", missing.alias("direction")).where("direction is not null")
