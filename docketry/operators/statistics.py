"""Counts of records and decisions, and rates with their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inbox import ListQuery, metric, visible


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded, null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole), digits)


def record_stats(records: DataFrame, q: ListQuery) -> DataFrame:
    """The portal's four figures, in one pass."""
    names = ("pending", "critical_high", "today", "upcoming")
    return records.where(visible()).agg(*[F.count_if(metric(n, q)).alias(n) for n in names])


def queue_stats(records: DataFrame, q: ListQuery) -> DataFrame:
    """Waiting records by severity, those that failed and may be tried again, and the oldest one's age in days."""
    failed = F.col("processing_status") == "AI_FAILED"
    age = F.datediff(F.lit(q.as_of).cast("date"), F.to_date(F.min("detected_at")))
    waiting = records.where(visible() & (F.col("review_status") == "pending"))
    return waiting.groupBy("severity").agg(
        F.count("*").alias("waiting"),
        F.count_if(failed & (F.col("ai_attempts") >= 3)).alias("exhausted"),
        F.count_if(failed & (F.col("ai_attempts") < 3)).alias("retryable"),
        age.cast("long").alias("oldest_days"),
    )


def decision_stats(records: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Decided records, approvals with other units than proposed, and the share without."""
    changed = suggestions.where(((F.col("origin") == "manual") & F.col("is_active")) | ((F.col("origin") == "ai") & ~F.col("is_active")))
    marked = records.join(changed.select("reg_id").distinct().withColumn("changed", F.lit(True)), "reg_id", "left")
    approved = F.col("review_status") == "approved"
    counts = marked.agg(
        F.count_if(approved).alias("approved"),
        F.count_if(approved & F.coalesce("changed", F.lit(False))).alias("with_change"),
        F.count_if(F.col("review_status") == "rejected").alias("rejected"),
    )
    return counts.withColumn("unit_accuracy", rate(F.col("approved") - F.col("with_change"), F.col("approved")))


def pipeline_counts(records: DataFrame, nodes: list[str]) -> DataFrame:
    """A row for each node of the pipeline, with 0 where nothing is, and for each status that is no node."""
    counts = records.groupBy(F.col("processing_status").alias("node")).agg(F.count("*").alias("n"), F.min("detected_at").alias("since"))
    known = records.sparkSession.createDataFrame([(x,) for x in nodes], "node string")
    joined = F.broadcast(known).join(counts, "node", "left")  # the given nodes
    others = counts.join(F.broadcast(known), "node", "left_anti").select("node", "n", "since")
    return joined.select("node", "n", "since").unionByName(others).select("node", F.coalesce("n", F.lit(0)).alias("n"), F.to_date("since").cast("string").alias("oldest"))


def archive_tabs(records: DataFrame) -> DataFrame:
    """Counts of the archive's tabs."""
    tabs = F.when(~F.col("is_relevant"), "irrelevant").when(F.col("review_status") == "pending", "open").otherwise(F.col("review_status"))
    return records.groupBy(tabs.alias("tab")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / 20).cast("long").alias("pages"))


def review_flow(records: DataFrame, q: ListQuery) -> DataFrame:
    """Waiting records, and those decided whose publication is a day, a week or a month back."""
    decided = F.col("review_status") != "pending"
    back = F.datediff(F.lit(q.as_of).cast("date"), "publish_date")
    windows = [F.count_if(decided & back.between(0, d)).alias(f"decided_{d}d") for d in (1, 7, 30)]
    return records.where(visible()).agg(F.count_if(~decided).alias("waiting"), *windows)


def usage_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.avg(value), 3).alias("mean"), F.round(F.sum(value), 2).alias("total"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of Wilson's interval of a rate, rounded to three digits; null for no trial."""
    p = F.try_divide(successes.cast("double"), n)
    wide = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / wide
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / wide
    return F.round(F.greatest(F.lit(0.0), centre - half), 3), F.round(F.least(F.lit(1.0), centre + half), 3)


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """The exact two-sided p of discordant pairs, rounded to four digits; null without any.

    Terms of the binomial tail are carried as logarithms, so no count overflows.
    """
    n, k = a_only + b_only, F.least(a_only, b_only)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), (-n * F.log(F.lit(2.0))).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        total = F.greatest(state["total"], term) + F.log1p(F.exp(-F.abs(state["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.exp(F.aggregate(steps, start, add)["total"])
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 4))
