"""What runs report of their channels: issues, retries, and when a channel's first full pass is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Empty lists in a row that count as a real one, and runs after which a first pass is closed anyway.
EMPTY_RUNS, MOST_RUNS = 3, 48
#: What is said of a channel, in this order; the number is that of the column's items.
ISSUES = (("error", "{}"), ("failed", "{} failed for now"), ("gave_up", "{} given up"), ("incomplete", "list incomplete"), ("conflicts", "{} id conflicts"), ("pending", "{} attachments pending"))


def run_issues(reports: DataFrame) -> DataFrame:
    """run_id and its issues, channel by channel in order of their names, in the order of :data:`ISSUES`.

    ``reports``: run_id, channel, error, failed, gave_up, incomplete, conflicts,
    pending.  Runs without an issue have an empty text.
    """

    def said(name: str, form: str) -> Column:
        value = F.col(name)
        there = value.isNotNull() if name == "error" else value if name == "incomplete" else value > 0
        before, _, after = form.partition("{}")
        return F.when(there, F.concat(F.lit(before), value.cast("string"), F.lit(after)) if "{}" in form else F.lit(form))

    texts = F.filter(F.array(*[said(*x) for x in ISSUES]), lambda x: x.isNotNull())
    own = F.struct("channel", F.array_join(F.transform(texts, lambda x: F.concat(F.col("channel"), F.lit(": "), x)), "; ").alias("said"))
    lists = F.filter(F.array_sort(F.collect_list(own)), lambda x: x["said"] != "")  # a run has a few channels
    return reports.groupBy("run_id").agg(F.array_join(F.transform(lists, lambda x: x["said"]), "; ").alias("issues"))


def baselines(runs: DataFrame) -> DataFrame:
    """channel, runs, closed_at (its run's number, null while open) and whether it was forced.

    ``runs``: channel, place, empty, open (deferred, failed or incomplete items).
    A pass closes at the first run that leaves nothing open and whose list isn't
    empty, or is for the third time in a row; after 48 runs it is closed anyway.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "empty", "open")))  # the runs of one channel's first pass
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("blank"), F.lit(None).cast("int").alias("closed"), F.lit(False).alias("forced"))

    def step(s: Column, x: Column) -> Column:
        n, blank = s["n"] + 1, F.when(x["empty"], s["blank"] + 1).otherwise(0)
        done = ~x["open"] & (~x["empty"] | (blank >= EMPTY_RUNS))
        closes = s["closed"].isNull() & (done | (n >= MOST_RUNS))
        return F.struct(n.alias("n"), blank.alias("blank"), F.when(closes, n).otherwise(s["closed"]).alias("closed"), F.when(closes, ~done).otherwise(s["forced"]).alias("forced"))

    folded = runs.groupBy("channel").agg(F.aggregate(rows, start, step).alias("s"))
    return folded.select("channel", F.col("s.n").alias("runs"), F.col("s.closed").alias("closed_at"), F.col("s.forced").alias("forced"))


def channel_rows(runs: DataFrame) -> DataFrame:
    """A row a run and channel of the map ``channels`` (name -> struct of new, failed), missing numbers being 0."""
    rows = runs.select("run_id", F.explode("channels").alias("channel", "x"))
    return rows.select("run_id", "channel", F.coalesce("x.new", F.lit(0)).alias("new"), F.coalesce("x.failed", F.lit(0)).alias("failed"))


def touched(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored rows (doc_id, hash, title, checked_at) after a listing showed some of them unchanged (doc_id, hash, title, at)."""
    both = stored.join(seen.select("doc_id", F.col("hash").alias("h"), F.col("title").alias("t"), "at"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("h", "hash").alias("hash"), F.coalesce("t", "title").alias("title"), F.coalesce("at", "checked_at").alias("checked_at"))


def retry_entries(failures: DataFrame, most: int = 5, base_minutes: int = 15) -> DataFrame:
    """Each failed item (item, attempts, fatal, at) with its count, whether it is given up, and its next try after doubling waits."""
    tried = F.col("attempts") + 1
    gone = F.col("fatal") | (tried >= most)
    wait = F.lit(base_minutes) * F.pow(F.lit(2), tried - 1).cast("int")
    return failures.select("item", tried.alias("attempts"), gone.alias("permanent"), F.when(~gone, F.col("at") + F.make_interval(mins=wait)).alias("next_try_at"))


def citations(claims: DataFrame) -> DataFrame:
    """reg_id, number, doc_id, quote: the passages of a summary, numbered as they come, each once; those of manual texts aren't cited."""
    once = claims.where("NOT manual").groupBy("reg_id", "doc_id", "quote").agg(F.min("place").alias("place"))
    number = F.row_number().over(Window.partitionBy("reg_id").orderBy("place", "doc_id", "quote"))
    return once.select("reg_id", number.alias("number"), "doc_id", "quote")


def grounding(claims: DataFrame) -> DataFrame:
    """reg_id, its claims with a passage, all of its claims, and the share, 0 where it has none."""
    held = F.count_if(F.col("quote").isNotNull())
    return claims.groupBy("reg_id").agg(held.alias("verified"), F.count("claim").alias("claims"), F.round(F.coalesce(held / F.nullif(F.count("claim"), F.lit(0)), F.lit(0.0)), 4).alias("score"))
