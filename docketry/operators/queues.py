"""What waits for which stage, in which order, what it will cost, and how the stages do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tries before a record is left to people, and the stage a failure belongs to if none is named.
MOST_ATTEMPTS, FIRST_STAGE = 3, "relevance"
STAGES = ("relevance", "summary", "units")


def _failed(stage: str) -> Column:
    return (F.col("status") == "AI_FAILED") & (F.coalesce("stage", F.lit(FIRST_STAGE)) == stage) & (F.col("attempts") < MOST_ATTEMPTS)


def may_classify(force: bool = False, baseline: bool = False) -> Column:
    """New records and retryable failures of this stage; baseline ones on request, merged ones never."""
    fits = (F.col("status") == "NEW") | _failed("relevance") | (F.lit(baseline) & (F.col("status") == "BASELINE"))
    return (F.col("status") != "MERGED") & (F.lit(force) | fits)


def may_summarize(force: bool = False) -> Column:
    return (F.col("status") != "MERGED") & (F.lit(force) | (F.col("status") == "RELEVANT") | _failed("summary"))


def may_match() -> Column:
    """Summarized records, and relevant ones that are blocked and never were matched."""
    return (F.col("status") == "SUMMARIZED") | ((F.col("status") == "RELEVANT") & F.col("blocked") & ~F.col("matched")) | _failed("units")


def next_in_tiers(rows: DataFrame, most: int) -> DataFrame:
    """The next records to summarize: new ones, then failed ones, then blocked ones, each by id, until ``most`` are found."""
    tier = F.when(F.col("blocked"), 2).when(F.col("status") == "AI_FAILED", 1).otherwise(0)
    return rows.where(may_summarize()).withColumn("tier", tier).orderBy("tier", "reg_id").limit(most).select("reg_id", "tier")


def pending_documents(docs: DataFrame, most: int) -> DataFrame:
    """Documents to take in: waiting ones and retryable failures; used-up ones are out before the limit is taken."""
    open_ = (F.col("state") == "PENDING") | ((F.col("state") == "FAILED") & (F.col("attempts") < MOST_ATTEMPTS))
    return docs.where(open_).orderBy("doc_id").limit(most)


def pending_by_stage(rows: DataFrame) -> DataFrame:
    """stage, how many records wait for it, and the oldest of them."""
    stage = F.when(may_classify(), "relevance").when(may_summarize(), "summary").when(may_match(), "units")
    return rows.select("reg_id", stage.alias("waits")).where("waits is not null").groupBy("waits").agg(F.count("*").alias("n"), F.min("reg_id").alias("first"))


def node_metrics(rows: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """A row a status: its records, whole hours that the oldest waits, failures to retry and used up; and records done in 24 hours by task."""
    failed = F.col("status") == "AI_FAILED"
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.min("detected_at"))) / 3600)
    waiting = rows.groupBy(F.col("status").alias("node")).agg(F.count("*").alias("n"), hours.alias("oldest_hours"), F.count_if(failed & (F.col("attempts") < MOST_ATTEMPTS)).alias("retryable"), F.count_if(failed & (F.col("attempts") >= MOST_ATTEMPTS)).alias("exhausted"))
    done = calls.where((F.col("status") == "success") & (F.col("started_at") >= now - F.expr("interval 24 hours"))).groupBy(F.concat(F.lit("task:"), F.col("task")).alias("node")).agg(F.count_distinct("reg_id").alias("n"))
    return waiting.unionByName(done, allowMissingColumns=True)


def ai_queue(rows: DataFrame) -> DataFrame:
    """One row: what waits for the model, failures to retry and used up, and the oldest day; a column a stage of the failures."""
    failed = F.col("status") == "AI_FAILED"
    stage = F.coalesce("stage", F.lit(FIRST_STAGE))
    waits = F.col("status").isin("NEW", "RELEVANT", "SUMMARIZED")
    counts = [F.count_if(failed & (stage == s)).alias(f"failed_{s}") for s in STAGES]
    return rows.agg(F.count_if(waits).alias("waiting"), F.count_if(failed & (F.col("attempts") < MOST_ATTEMPTS)).alias("retryable"), F.count_if(failed & (F.col("attempts") >= MOST_ATTEMPTS)).alias("exhausted"), F.min(F.when(waits, F.to_date("detected_at"))).alias("oldest"), *counts)


def exhausted_failures(rows: DataFrame, shown: int = 50) -> DataFrame:
    """One row: how many records are used up, at which stages, and the first ids."""
    out = rows.where((F.col("status") == "AI_FAILED") & (F.col("attempts") >= MOST_ATTEMPTS)).withColumn("stage", F.coalesce("stage", F.lit(FIRST_STAGE)))
    first = out.orderBy("reg_id").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("reg_id")), ",").alias("first"))
    return out.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages")).crossJoin(F.broadcast(first))


def rerun_selection(rows: DataFrame, since: str, until: str, links: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Records published in a period, of one source if given, that a stage may be run for again."""
    within = F.col("publish_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    found = rows.where(within & (F.col("status") != "MERGED"))
    return found if source is None else found.join(links.where(F.col("source") == source).select("reg_id"), "reg_id", "left_semi")


def rerun_cost(selected: DataFrame, calls: DataFrame, calls_each: dict[str, int], sample: int = 500) -> DataFrame:
    """stage, calls, minutes (1 at least): by the median time of its newest successful calls."""
    newest = Window.partitionBy("task").orderBy(F.desc("started_at"), F.desc("run_id"))
    times = calls.where("status = 'success'").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= sample).groupBy("task").agg(F.median("latency").alias("latency"))
    spark = selected.sparkSession
    stages = spark.createDataFrame(list(calls_each.items()), "task string, each int")
    n = selected.agg(F.count("*").alias("n"))
    made = stages.join(times, "task", "left").crossJoin(F.broadcast(n)).withColumn("calls", F.col("n") * F.col("each"))
    minutes = F.greatest(F.ceil(F.round(F.col("calls") * F.coalesce("latency", F.lit(0.0)) / 60, 6)), F.lit(1))
    return made.select(F.col("task").alias("stage"), "calls", minutes.cast("long").alias("minutes"))


def failed_selection(rows: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """reg_id and the stage that failed."""
    stage = F.coalesce("stage", F.lit(FIRST_STAGE))
    return rows.where((F.col("status") == "AI_FAILED") & stage.isin(*stages)).select("reg_id", stage.alias("stage"))


def strikes(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """reg_id, unavailable answers since the last other one, and how often ``most`` in a row made it a failure; counting begins anew then."""
    rows = F.array_sort(F.collect_list(F.struct("at", "unavailable")))  # tries of one record: a few
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("failures"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["unavailable"], s["run"] + 1).otherwise(0)
        return F.struct(F.when(run >= most, 0).otherwise(run).alias("run"), (s["failures"] + (run >= most).cast("int")).alias("failures"))

    done = outcomes.groupBy("reg_id").agg(F.aggregate(rows, start, step).alias("s"))
    return done.select("reg_id", F.col("s.run").alias("run"), F.col("s.failures").alias("failures"))


def last_success(runs: DataFrame) -> DataFrame:
    """The newest successful run's start of each source; partial ones don't count."""
    return runs.groupBy("source").agg(F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"))


def heartbeat(beats: DataFrame) -> DataFrame:
    """The newest beat of each worker."""
    return beats.groupBy("worker").agg(F.max(F.struct("at", "state")).alias("x")).select("worker", F.col("x.at").alias("at"), F.col("x.state").alias("state"))


def running_not_ingested(beats: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources that a worker says it runs, of which no row says so yet."""
    return beats.where("state = 'running'").select("source").distinct().join(runs.where("status = 'running'").select("source"), "source", "left_anti")


def crawler_findings(requests: DataFrame, now: Column, beats: DataFrame, lag_minutes: int = 15, stuck_minutes: int = 30) -> DataFrame:
    """finding, n: no fresh beat, requests that wait or run too long, and requests that failed in 24 hours; only what there is."""
    age = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 60
    silent = beats.agg(F.max("at").alias("at")).select(F.lit("no_heartbeat").alias("finding"), F.when(F.col("at").isNull() | (age("at") > lag_minutes), 1).otherwise(0).cast("long").alias("n"))
    kinds = {
        "lag": (F.col("state") == "queued") & (age("at") > lag_minutes),
        "stuck": (F.col("state") == "running") & (age("at") > stuck_minutes),
        "failed": (F.col("state") == "failed") & (age("at") <= 24 * 60),
    }
    counts = requests.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")
    return silent.unionByName(rows).where("n > 0")


def health_findings(states: DataFrame, silent: DataFrame, volumes: DataFrame) -> DataFrame:
    """All findings of sources in one table (source, finding, level)."""
    fetch = states.where("state <> 'ok'").select("source", F.lit("fetch_error").alias("finding"), F.col("state").alias("level"))
    quiet = silent.where("elapsed > tolerance").select("source", F.lit("silence").alias("finding"), F.lit("delayed").alias("level"))
    odd = volumes.where("state <> 'usual'").select("source", F.col("state").alias("finding"), F.lit("delayed").alias("level"))
    return fetch.unionByName(quiet).unionByName(odd)


def health_summary(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a source: its worst level and its findings, and the banner that the worst of all gives."""
    level = F.max(F.when(F.col("level") == "down", 2).otherwise(1))
    own = findings.groupBy("source").agg(level.alias("worst"), F.array_join(F.array_sort(F.collect_set("finding")), ",").alias("findings"))
    worst = findings.agg(F.coalesce(F.max(F.when(F.col("level") == "down", 2).otherwise(1)), F.lit(0)).alias("all"))
    name = lambda c: F.when(F.col(c) == 2, "down").when(F.col(c) == 1, "delayed").otherwise("ok")
    return sources.select("source").distinct().join(own, "source", "left").crossJoin(F.broadcast(worst)).select("source", name("worst").alias("level"), F.coalesce("findings", F.lit("")).alias("findings"), name("all").alias("banner"))


def newest_of_nodes(rows: DataFrame, most: int = 20) -> DataFrame:
    """The newest records of each status."""
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("detected_at"), F.desc("reg_id")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("status", "place", "reg_id")


def recent_runs(runs: DataFrame, most: int = 30, gap_hours: int = 12) -> DataFrame:
    """The newest runs with their seconds, and ``backfill`` where a source's run follows the one before after more than ``gap_hours``."""
    before = F.lag("started_at").over(Window.partitionBy("source").orderBy("started_at", "run_id"))
    gap = F.unix_timestamp("started_at") - F.unix_timestamp(before)
    return runs.withColumn("backfill", F.coalesce(gap > gap_hours * 3600, F.lit(False))).orderBy(F.desc("run_id")).limit(most).select("run_id", "source", "status", "backfill")


def snapshot(beats: DataFrame, requests: DataFrame, now: Column, stale_minutes: int = 10, recent_hours: int = 24, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Where the crawlers and their requests stand: one row of the crawlers, and requests with ``state`` queued or recent.

    ``beats``: host, at, running (a list of sources); ``requests``: request_id,
    source, status, created_at, finished_at.  Hosts that were heard of within a
    day count; what runs is told by live ones alone.  Of the finished requests
    the newest ``most`` of the last hours are shown (the feature of this list).
    """
    heard = beats.where(F.col("at") >= now - F.expr("interval 1 day"))
    live = F.col("at") >= now - F.expr(f"interval {stale_minutes} minutes")
    running = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(live, F.col("running"))))))
    state = heard.agg(F.max("at").alias("heartbeat_at"), F.count_distinct("host").alias("hosts"), F.array_join(running, ",").alias("running")).select("heartbeat_at", F.coalesce(F.col("heartbeat_at") < now - F.expr(f"interval {stale_minutes} minutes"), F.lit(True)).alias("stale"), "hosts", "running")
    queued = requests.where(F.col("status").isin("pending", "running")).withColumn("state", F.lit("queued"))
    done = requests.where(F.col("status").isin("done", "failed") & (F.col("finished_at") >= now - F.expr(f"interval {recent_hours} hours")))
    recent = done.orderBy(F.desc("finished_at"), F.desc("request_id")).limit(most).withColumn("state", F.lit("recent"))
    return state, queued.unionByName(recent).select("request_id", "source", "status", "state")
