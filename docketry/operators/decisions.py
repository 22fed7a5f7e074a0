"""What people do to records, as events, and the state that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a reason for changing a decision has this many characters at least.
LEAST_REASON = 5
DECISIONS = ("approved", "rejected")


def decide(records: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (reg_id, decision, done, problem): every decision asked for (reg_id, decision, reason, actor) is held against the record's state.

    ``records``: reg_id, review_status, visible, has_units.  A record is asked
    for once at a time; of several rows the first by actor counts.
    """
    first = F.row_number().over(Window.partitionBy("reg_id").orderBy("actor", "decision"))
    rows = asked.withColumn("n", first).join(records, "reg_id", "left")
    reason = F.length(F.trim(F.coalesce("reason", F.lit(""))))
    problem = F.when(F.col("n") > 1, "asked twice").when(F.col("review_status").isNull(), "unknown record").when(~F.col("visible"), "not visible")
    problem = problem.when(~F.col("decision").isin(*DECISIONS), "unknown decision").when(F.col("review_status") != "pending", "already decided")
    problem = problem.when((F.col("decision") == "approved") & ~F.col("has_units"), "no unit").when((F.col("decision") == "rejected") & (reason == 0), "no reason")
    return rows.select("reg_id", "decision", "actor", problem.isNull().alias("done"), problem.alias("problem"))


def revise(records: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (reg_id, decision, done, problem) of changed decisions: a reason is needed, and nothing may stay as it was."""
    reason = F.length(F.trim(F.coalesce("reason", F.lit(""))))
    problem = F.when(F.col("review_status").isNull(), "unknown record").when(F.col("review_status") == "pending", "not decided").when(reason < LEAST_REASON, "no reason")
    problem = problem.when(F.col("decision") == F.col("review_status"), "no change")
    return asked.join(records.select("reg_id", "review_status"), "reg_id", "left").select("reg_id", "decision", problem.isNull().alias("done"), problem.alias("problem"))


def outbox(decided: DataFrame) -> DataFrame:
    """A message for each decision that was made: reg_id, topic, key; the key makes a repeat harmless."""
    key = F.sha2(F.concat_ws("|", F.col("reg_id").cast("string"), "decision", "actor"), 256)
    return decided.where("done").select("reg_id", F.concat(F.lit("decision."), F.col("decision")).alias("topic"), key.alias("key"))


def state_of(history: DataFrame) -> DataFrame:
    """reg_id, the decision in force (null after it was reopened), and how often it was revised."""
    last = F.max_by(F.when(F.col("kind") == "decided", F.col("value")), F.struct("at", "event_id"))
    revisions = F.greatest(F.count_if(F.col("kind") == "decided") - 1, F.lit(0)) + F.count_if(F.col("kind") == "reopened")
    return history.where(F.col("kind").isin("decided", "reopened")).groupBy("reg_id").agg(last.alias("decision"), revisions.alias("revisions"))


def change_units(current: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (reg_id, unit, change, rank): kept, added, removed or unknown.

    ``current``: reg_id, unit; ``wanted``: reg_id, place, unit, repeated units
    counting at their first place.  Ranks are numbered anew from 1.
    """
    once = wanted.groupBy("reg_id", "unit").agg(F.min("place").alias("place"))
    once = once.join(known.select("unit", F.lit(True).alias("known")), "unit", "left")
    rank = F.row_number().over(Window.partitionBy("reg_id", "known").orderBy("place", "unit"))
    ranked = once.withColumn("rank", F.when(F.col("known"), rank))
    asked = wanted.select("reg_id").distinct()
    before = current.select("reg_id", "unit").distinct().join(asked, "reg_id", "left_semi").withColumn("before", F.lit(True))
    both = ranked.join(before, ["reg_id", "unit"], "full")
    change = F.when(F.col("place").isNull(), "removed").when(F.col("known").isNull(), "unknown").when(F.col("before"), "kept").otherwise("added")
    return both.select("reg_id", "unit", change.alias("change"), "rank")


def content_versions(edits: DataFrame) -> DataFrame:
    """Each edit as the next version of its record, the newest being current."""
    order = Window.partitionBy("reg_id").orderBy("at", "event_id")
    newest = F.lead("event_id").over(order).isNull()
    return edits.select("reg_id", "event_id", F.row_number().over(order).alias("version"), newest.alias("current"), "value")


def original_and_edited(edits: DataFrame) -> DataFrame:
    """reg_id, the first value, the value now, and whether they differ."""
    key = F.struct("at", "event_id")
    return edits.groupBy("reg_id").agg(F.min_by("value", key).alias("original"), F.max_by("value", key).alias("now")).withColumn("edited", ~F.col("original").eqNullSafe(F.col("now")))


def trail(history: DataFrame, records: DataFrame) -> DataFrame:
    """The events of each record in order, from its detection, which is put in where no event says it."""
    events = history.select("reg_id", "at", F.col("event_id").alias("n"), "kind")
    detected = events.where("kind = 'detected'").select("reg_id")
    found = records.join(detected, "reg_id", "left_anti").join(events.select("reg_id").distinct(), "reg_id", "left_semi").select("reg_id", F.col("detected_at").alias("at"), F.lit(-1).cast("long").alias("n"), F.lit("detected").alias("kind"))
    place = F.row_number().over(Window.partitionBy("reg_id").orderBy(F.col("n") >= 0, "at", "n"))
    return events.unionByName(found).select("reg_id", place.alias("place"), "kind")


def synced(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (code, name, active, change) after an upsert by code; what isn't wanted any more is kept, but not active."""
    both = current.select("code", F.col("name").alias("old"), F.col("active").alias("was")).join(wanted.select("code", F.col("name").alias("new")), "code", "full")
    change = F.when(F.col("old").isNull() & F.col("was").isNull(), "added").when(F.col("new").isNull(), F.when(F.col("was"), "retired").otherwise("gone")).when(~F.col("was") | (F.col("old") != F.col("new")), "changed").otherwise("same")
    return both.select("code", F.coalesce("new", "old").alias("name"), F.col("new").isNotNull().alias("active"), change.alias("change"))


def latest_active(decisions: DataFrame) -> DataFrame:
    """Every learning record (reg_id, event_id, at), the newest of a record being the active one."""
    newest = F.row_number().over(Window.partitionBy("reg_id").orderBy(F.desc("at"), F.desc("event_id"))) == 1
    return decisions.select("reg_id", "event_id", newest.alias("active"))


def retained(samples: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return samples.where(F.col("at") >= now - F.make_interval(days=F.lit(days)))


def reset_counts(docs: DataFrame, source: str) -> DataFrame:
    """What resetting a source would delete, by role; nothing is deleted."""
    return docs.where(F.col("source") == source).groupBy("role").agg(F.count("*").alias("documents"), F.count_distinct("reg_id").alias("records"))


def setting_values(stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, value, problem: stored texts over the defaults; what isn't a number in its range is left out and said.

    ``ranges``: key, low, high, default; ``stored``: key, text.
    """
    value = F.try_to_number("text", F.lit("S999999999.999999")).cast("double")
    parsed = ranges.join(stored, "key", "left").withColumn("parsed", F.when(F.col("text").rlike(r"^[+-]?\d+(\.\d+)?$"), value))
    problem = F.when(F.col("text").isNull(), None).when(F.col("parsed").isNull(), "not a number").when(~F.col("parsed").between(F.col("low"), F.col("high")), "out of range")
    known = parsed.withColumn("problem", problem)
    unknown = stored.join(ranges, "key", "left_anti").select("key", F.lit(None).cast("double").alias("value"), F.lit("unknown setting").alias("problem"))
    return known.select("key", F.when(F.col("problem").isNull() & F.col("parsed").isNotNull(), F.col("parsed")).otherwise(F.col("default")).alias("value"), "problem").unionByName(unknown)


def inconsistent(values: DataFrame, below: list[tuple[str, str]]) -> DataFrame:
    """Pairs (low, high) of settings of which the first isn't under the second."""
    spark = values.sparkSession
    pairs = spark.createDataFrame(below, "low string, high string")
    side = lambda s: values.select(F.col("key").alias(s), F.col("value").alias(f"{s}_value"))
    return pairs.join(side("low"), "low").join(side("high"), "high").where("low_value >= high_value").select("low", "high")


def setting_changes(writes: DataFrame) -> DataFrame:
    """The writes (key, at, value, by) that changed a value, with the value before."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("at"))
    return writes.withColumn("old", before).where(~F.col("old").eqNullSafe(F.col("value"))).select("key", "at", "old", "value", "by")
