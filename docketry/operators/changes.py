"""Change detection and versions of an archive of publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running


def listing_fingerprint(title: Column, published: Column, version_key: Column, url: Column) -> Column:
    """Changes whenever what a listing shows of an item does."""
    text = [F.coalesce(x.cast("string"), F.lit("")) for x in (title, published, version_key, url)]
    return F.sha1(F.concat_ws("|", *text))


def upsert_actions(listed: DataFrame, archived: DataFrame, budget: int, now: Column, refresh_days: int = 30) -> DataFrame:
    """What to do with each listed item.

    ``listed``: source, external_id, channel, url, fingerprint, place;
    ``archived``: the newest versions, with source, external_id, channel, url,
    fingerprint, checked_at.  An item under another channel and URL is a
    conflict; of those that need fetching only ``budget`` a source are, by place.
    """
    old = archived.select("source", "external_id", *[F.col(c).alias(f"old_{c}") for c in ("channel", "url", "fingerprint", "checked_at")])
    both = listed.join(old, ["source", "external_id"], "left")
    conflict = (F.col("old_channel") != F.col("channel")) & (F.col("old_url") != F.col("url"))
    due = F.unix_timestamp(now) - F.unix_timestamp("old_checked_at") >= refresh_days * 86400
    wish = F.when(conflict, "conflict").when(F.col("old_fingerprint").isNull(), "new")
    wish = wish.when(F.col("old_fingerprint") != F.col("fingerprint"), "changed").when(due, "refresh").otherwise("unchanged")
    needs = F.col("wish").isin("new", "changed", "refresh")
    wished = both.withColumn("wish", wish).select("source", "external_id", "place", "wish")
    turns = running(wished, ["source"], [F.col("place"), F.col("external_id")], counts={"turn": needs})
    return turns.select("source", "external_id", F.when(needs & (F.col("turn") > budget), "deferred").otherwise(F.col("wish")).alias("action"))


def versions(documents: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Number the versions of each key and mark the newest; equal neighbours are no new version."""
    by = Window.partitionBy(*key).orderBy(*order)
    changed = documents.withColumn("_before", F.lag("sha").over(by)).where(~F.col("_before").eqNullSafe(F.col("sha"))).drop("_before")
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return changed.withColumn("version", F.row_number().over(by).cast("long")).withColumn("is_latest", F.row_number().over(back) == 1)


def latest(documents: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate, so hot keys are combined before the shuffle."""
    row = F.max(F.struct(*order, *[c for c in documents.columns if c not in (*key, *order)]))
    return documents.groupBy(*key).agg(row.alias("_r")).select(*key, "_r.*")


def distinct_attachments(attachments: DataFrame) -> DataFrame:
    """Of each parent's attachments with equal bytes the first."""
    return attachments.groupBy("parent", "sha").agg(F.min("place").alias("place"))


def missing_children(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Links (parent, external_id) that no child stands for."""
    return expected.join(present, ["parent", "external_id"], "left_anti")


def backoff_hours(attempts: Column) -> Column:
    """1, 2, 4 ... hours after the first, second ... attempt, a day at most."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(24.0))


def is_permanent(transient: Column, status: Column) -> Column:
    """An error that trying again won't mend."""
    client = status.between(400, 499) & ~status.isin(408, 429)
    return ~transient & (status.isNull() | client)


def is_baseline(channel_baseline: Column, published: Column, history_from: Column) -> Column:
    return F.when(history_from.isNull() | published.isNull(), channel_baseline).otherwise(published < history_from)


def run_status(channels: DataFrame) -> DataFrame:
    """A run failed if all its channels did, and is partial if any did."""
    failed = F.col("status") == "failed"
    state = F.when(F.bool_and(failed), "failed").when(F.bool_or(failed | (F.col("status") == "partial")), "partial").otherwise("success")
    return channels.groupBy("run").agg(state.alias("status"), F.count("*").alias("channels"), F.count_if(failed).alias("failed"))


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str, within: int = 50) -> DataFrame:
    """Fill gaps of ``value`` with the last one that a key had within so many rows."""
    found = running(rows, [key], [F.col(c) for c in order], lasts={"_last": F.col(value)})
    near = F.when(F.col("_n") - F.col("_last.at") <= within, F.col("_last.value"))
    return found.withColumn(value, near).select(*rows.columns)


def date_chunks(spans: DataFrame, days: int = 62) -> DataFrame:
    """Split spans (id, first, last) into chunks of so many days."""
    start = F.explode(F.sequence("first", "last", F.expr(f"interval {days} days"))).alias("start")
    return spans.select("id", "last", start).select("id", F.col("start").cast("string").alias("start"), F.least(F.date_add("start", days - 1), "last").cast("string").alias("stop"))


def rebaseline(records: DataFrame, cutoff: Column) -> DataFrame:
    """Baseline records published since a cutoff become new ones; never the reverse."""
    back = (F.col("processing_status") == "BASELINE") & (F.col("publish_date") >= cutoff)
    return records.withColumn("processing_status", F.when(back, "NEW").otherwise(F.col("processing_status")))


def rebaseline_plan(sources: DataFrame, records: DataFrame, archived: DataFrame, cutoff: Column, today: Column) -> DataFrame:
    """source, action, converted, earliest, first, last: what moving the baseline to ``cutoff`` asks of each source.

    ``sources``: source, deep (whether its lists can be read far back), dated
    (whether they are asked for by days); ``records``: source, processing_status,
    publish_date; ``archived``: source, published_at.  ``covered``: the archive
    reaches the cutoff; ``crawl``: it is to be read back; ``crawl_shallow``: never
    read, what the lists show will do; ``shallow``: only what is there can be
    converted.  ``first`` and ``last`` bound the days to ask a dated source for.
    """
    converted = records.where((F.col("processing_status") == "BASELINE") & (F.col("publish_date") >= cutoff)).groupBy("source").agg(F.count("*").alias("n"))
    earliest = archived.groupBy("source").agg(F.min("published_at").alias("earliest"))
    both = sources.join(converted, "source", "left").join(earliest, "source", "left")
    action = F.when(F.col("earliest") <= cutoff, "covered").when(F.col("deep"), "crawl").when(F.col("earliest").isNull(), "crawl_shallow").otherwise("shallow")
    last = F.coalesce(F.least(today, F.date_sub("earliest", 1)), today)
    asked = (action == "crawl") & F.col("dated") & (last >= cutoff)
    return both.select("source", action.alias("action"), F.coalesce("n", F.lit(0)).alias("converted"), "earliest", F.when(asked, cutoff).alias("first"), F.when(asked, last).alias("last"))


def version_extra(extra: Column, summary: Column, missing: Column) -> Column:
    """What a new version's row notes: the listing's own notes, its summary if there is one, and attachments that couldn't be had."""
    more = F.map_from_entries(F.filter(F.array(F.struct(F.lit("summary").alias("key"), F.nullif(summary, F.lit("")).alias("value")), F.struct(F.lit("missing_attachments").alias("key"), F.when(F.size(missing) > 0, F.to_json(missing)).alias("value"))), lambda e: e["value"].isNotNull()))
    own = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(own, more)


def canonical_link(url: Column) -> Column:
    """The id of a legal text whose site has three forms of address, else null."""
    number = lambda name: F.regexp_extract(url, rf"(?i)[?&]{name}=(\d+)", 1)
    numbered = F.concat_ws(".", number("MevzuatTur"), number("MevzuatTertip"), number("MevzuatNo"))
    short = F.regexp_extract(url, r"(?i)mevzuatmetin/(?:yonetmelik/)?(\d+\.\d+\.\d+)", 1)
    named = F.when(numbered.rlike(r"^\d+\.\d+\.\d+$"), numbered).otherwise(F.nullif(short, F.lit("")))
    return F.when(url.rlike(r"(?i)mevzuat\.gov\.tr"), F.concat(F.lit("mevzuat.gov.tr:"), named))


def stable_id(url: Column, pattern: str, prefix: str = "") -> Column:
    """What a pattern finds in a URL, with a prefix; else path and query."""
    found = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    rest = F.concat_ws("?", F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY")))
    return F.coalesce(F.concat(F.lit(prefix), found), rest)
