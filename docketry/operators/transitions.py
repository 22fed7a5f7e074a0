"""What a stage writes when it is done with a record: rows in, the next state of the table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import is_draft

# The kind of a draft, strategies that page back on their own, and the least length of a page's main text.
DRAFT = "Düzenleme Taslağı"
DEEP_STRATEGIES = ("resmi_gazete", "wordpress_api")
LEAST_MAIN_TEXT = 50


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``stored`` with each key of ``incoming`` put in or replaced by its last row in ``order``.

    The last row is found by an aggregate, so a key with very many rows is combined before the shuffle.
    """
    values = [c for c in incoming.columns if c not in key]
    last = incoming.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")
    return stored.join(last, key, "left_anti").unionByName(last.select(*stored.columns))


def main_documents(docs: DataFrame, source: str, channels: list[str] | None = None) -> DataFrame:
    """A source's latest main documents with the addresses of their latest attachments, in order.

    ``docs``: doc_id, parent, source, channel, role, url, is_latest.
    """
    latest = docs.where("is_latest")
    kids = latest.where("parent is not null").groupBy(F.col("parent").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("attachments"))
    main = latest.where((F.col("source") == source) & (F.col("role") != "attachment"))
    if channels:
        main = main.where(F.col("channel").isin(channels))
    return main.select("doc_id", "channel", "url").join(kids, "doc_id", "left").withColumn("attachments", F.coalesce("attachments", F.lit("")))


def classified(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """reg_id, processing_status, kind and severity after classification.

    ``records``: reg_id, title; ``decisions``: reg_id, relevant, kind, severity.
    A draft is one whatever the model called it, and only relevant records have
    a severity.
    """
    both = records.select("reg_id", "title").join(decisions, "reg_id")
    status = F.when(F.col("relevant"), "RELEVANT").otherwise("IRRELEVANT")
    return both.select("reg_id", status.alias("processing_status"), F.when(is_draft("title"), DRAFT).otherwise(F.col("kind")).alias("kind"), F.when(F.col("relevant"), F.col("severity")).alias("severity"))


def matched_units(stored: DataFrame, kept: DataFrame, asked: DataFrame) -> DataFrame:
    """Suggestions after records were matched anew: their active ones of the model are put out of use, the new ones follow.

    ``stored``: reg_id, unit, rank, origin, is_active; ``kept``: reg_id, unit,
    score; ``asked``: reg_id of the matched records, with or without a unit.
    """
    again = stored.join(asked.select("reg_id", F.lit(True).alias("again")), "reg_id", "left")
    old = again.withColumn("is_active", F.col("is_active") & ~(F.coalesce("again", F.lit(False)) & (F.col("origin") == "ai"))).drop("again")
    place = F.row_number().over(Window.partitionBy("reg_id").orderBy(F.desc("score"), "unit"))
    new = kept.select("reg_id", "unit", place.cast(stored.schema["rank"].dataType).alias("rank"), F.lit("ai").alias("origin"), F.lit(True).alias("is_active"))
    return old.select(*stored.columns).unionByName(new.select(*stored.columns))


def noted(notes: DataFrame, dates: DataFrame) -> DataFrame:
    """Of each record the notes whose quotes were found, in order of chunk and place, and the last chunk's date with a found quote.

    ``notes``: record, chunk, place, point, found; ``dates``: record, chunk,
    value, found.  Of two dates of one chunk the later counts; records without
    either have no row.
    """
    good = notes.where("found").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("chunk", "place", "point"))).alias("n"))
    told = good.select("record", F.array_join(F.transform("n", lambda x: x["point"]), "; ").alias("notes"))
    last = dates.where("found").groupBy("record").agg(F.max_by("value", F.struct("chunk", "value")).alias("effective"))
    return told.join(last, "record", "full")


def effective_basis(quote: Column, clause: Column, found: Column, sentence: Column, sentence_found: Column) -> Column:
    """Struct (text, origin, removed): the model's quote if it is a clause on the effect and stands in a source, else the text's own sentence.

    A clause that stands in no source is removed even where the sentence takes its place.
    """
    model, own = clause & found, sentence_found & sentence.isNotNull()
    text = F.when(model, quote).when(own, sentence)
    return F.struct(text.alias("text"), F.when(model, "model").when(own, "text").alias("origin"), F.coalesce(clause & ~found, F.lit(False)).alias("removed"))


def summary_versions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Summaries after new ones came: reg_id, version, is_current.

    ``fresh``: reg_id, sentences (verified ones); one without any leaves the
    record's summaries as they were.
    """
    good = fresh.where("sentences > 0").select("reg_id")
    next_version = good.join(stored.groupBy("reg_id").agg(F.max("version").alias("last")), "reg_id", "left").select("reg_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_current"))
    old = stored.join(good.withColumn("_new", F.lit(True)), "reg_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull())
    return old.select("reg_id", "version", "is_current").unionByName(next_version)


def example_pool(decided: DataFrame, titles: DataFrame) -> DataFrame:
    """One active example a record, of its last decision: reg_id, input_text, units, weight; corrections weigh twice.

    ``decided``: reg_id, at, event_id, units, corrected; ``titles``: reg_id,
    title, topics (array, null without a summary).
    """
    last = decided.groupBy("reg_id").agg(F.max_by(F.struct("units", "corrected"), F.struct("at", "event_id")).alias("d"))
    topics = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", ")
    text = F.concat(F.col("title"), F.lit(" | topics: "), F.when(topics == "", "-").otherwise(topics))
    return last.join(titles, "reg_id").select("reg_id", text.alias("input_text"), F.col("d.units").alias("units"), F.when(F.col("d.corrected"), 2.0).otherwise(1.0).alias("weight"))


def created_records(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The record that each of ``docs`` would open: doc_id, canonical_key, processing_status, review.

    ``docs``: doc_id, is_baseline, candidate (a pair to be looked at, or null);
    ``keys``: doc_id, key, strong, place.  A strong key comes before a weak one,
    and without any the document's own id is the key.
    """
    first = keys.groupBy("doc_id").agg(F.min_by("key", F.struct(~F.col("strong"), F.col("place"))).alias("key"))
    named = F.coalesce("key", F.concat(F.lit("raw:"), F.col("doc_id").cast("string")))
    status = F.when(F.col("is_baseline"), "BASELINE").otherwise("NEW")
    return docs.join(first, "doc_id", "left").select("doc_id", named.alias("canonical_key"), status.alias("processing_status"), F.col("candidate").isNotNull().alias("review"))


def stepped(docs: DataFrame) -> DataFrame:
    """What became of each document in one processing step: doc_id, outcome.

    ``docs``: doc_id, status, role, extracted, parent_known, method.  Linked ones
    are passed over; those whose text can't be read fail; attachments without
    their main document wait; the rest are new, merged or linked quietly.
    """
    attachment = F.col("role") == "attachment"
    outcome = F.when(F.col("status") == "LINKED", "skipped").when(~F.col("extracted"), "failed").when(attachment & ~F.col("parent_known"), "waiting")
    outcome = outcome.when(F.col("method") == "new", "new").when(~attachment & (F.col("method") != "same_document"), "merged").otherwise("linked")
    return docs.select("doc_id", outcome.alias("outcome"))


def step_report(outcomes: DataFrame) -> DataFrame:
    """One row: processed, failed, linked, new, merged."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(F.count_if(F.col("outcome") != "skipped").alias("processed"), is_("failed").alias("failed"), is_("new", "merged", "linked").alias("linked"), is_("new").alias("new"), is_("merged").alias("merged"))


def unit_hits(suggestions: DataFrame) -> DataFrame:
    """One row: records with final and suggested units, those whose first suggestion is final, and those with any that is.

    ``suggestions``: reg_id, unit, rank, origin, is_final.
    """
    ai, final = F.col("origin") == "ai", F.col("is_final")
    one = suggestions.groupBy("reg_id").agg(
        F.min_by(F.when(ai, F.col("unit")), F.when(ai, F.struct("rank", "unit"))).alias("first"),
        F.collect_set(F.when(ai, F.col("unit"))).alias("a"),
        F.collect_set(F.when(final, F.col("unit"))).alias("f"),
    )
    both = one.where((F.size("a") > 0) & (F.size("f") > 0))
    return both.agg(F.count("*").alias("records"), F.count_if(F.array_contains("f", F.col("first"))).alias("top1"), F.count_if(F.arrays_overlap("a", "f")).alias("any_hit"))


def deep_capable(channels: Column) -> Column:
    """Whether a source can be read back to a day: an enabled channel (strategy, enabled, pagination, urls) that pages."""

    def pages(c: Column) -> Column:
        own = c["strategy"].isin(*DEEP_STRATEGIES) | ((c["strategy"] == "css_list") & F.coalesce(c["pagination"], F.lit(False)))
        by_url = (c["strategy"] == "json_api") & F.exists(F.coalesce(c["urls"], F.array().cast("array<string>")), lambda u: F.contains(u, F.lit("page=")))
        return c["enabled"] & (own | by_url)

    return F.exists(channels, pages)


def done_chunks(jobs: DataFrame, cutoff: str, most: int = 50) -> DataFrame:
    """key of every chunk that one of the last ``most`` jobs (job_id, cutoff, crawl) finished under the same cutoff."""
    last = jobs.orderBy(F.desc("job_id")).limit(most).where(F.col("cutoff") == cutoff)
    return last.select(F.explode("crawl").alias("c")).where("c.status = 'done' AND c.key is not null").select("c.key").distinct()


def job_view(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, status, elapsed (whole seconds, of active jobs) and duration (of ended ones, to a tenth)."""
    seconds = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
    active = F.col("status").isin("queued", "running")
    elapsed = F.when(active, F.bround(seconds(now, F.coalesce("started_at", "created_at"))).cast("long"))
    return jobs.select("job_id", "status", elapsed.alias("elapsed"), F.bround(seconds(F.col("finished_at"), F.col("started_at")), 1).alias("duration"))


def evaluated(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evaluation rows: a severity is asked for only of items found relevant that have an expected one."""
    asked = F.coalesce(F.col("relevant"), F.lit(False)) & F.col("expected_severity").isNotNull()
    return items.join(predictions, "item_id", "left").select("item_id", "expected", F.col("relevant").alias("predicted"), "score", "expected_severity", F.when(asked, F.col("severity")).alias("severity"))


def main_text(selected: Column, main: Column, body: Column) -> Column:
    """Struct (text, method): the selector's text if there is any, the main text if it is long enough, else the longer of it and the body's."""
    main, body = F.coalesce(main, F.lit("")), F.coalesce(body, F.lit(""))
    chosen, long_enough = F.coalesce(selected, F.lit("")) != "", F.length(main) >= LEAST_MAIN_TEXT
    text = F.when(chosen, selected).when(long_enough | (F.length(body) <= F.length(main)), main).otherwise(body)
    return F.struct(text.alias("text"), F.when(chosen, "html_selector").when(long_enough, "html").otherwise("html_body").alias("method"))


def attached_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Links (doc_id, record, method, score, key) after further ones (with ``turn``) were attached: one a document, the last attached."""
    old = stored.withColumn("turn", F.lit(-1).cast("long"))
    row = F.struct("turn", "record", "method", "score", "key")
    return old.unionByName(new.select(*old.columns)).groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", "r.record", "r.method", "r.score", "r.key")


def irrelevant_reviews(records: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, examples and events after experts looked at what was put aside.

    ``records``: reg_id, title, rationale, is_relevant, processing_status,
    detected_at, ai_attempts, reviewed; ``verdicts``: reg_id, verdict (confirm or
    relevant), place (the first counts).  Only records put aside as irrelevant and
    not reviewed before are touched.  ``relevant`` takes one back into the stages,
    found now and with its attempts forgotten, and its example weighs twice.
    """
    first = verdicts.where(F.col("verdict").isin("confirm", "relevant")).groupBy("reg_id").agg(F.min_by("verdict", "place").alias("verdict"))
    waiting = records.where((F.col("processing_status") == "IRRELEVANT") & ~F.col("reviewed"))
    done = waiting.join(first, "reg_id")
    back = F.col("verdict") == "relevant"
    text = F.concat(F.col("title"), F.lit(" | "), F.substring(F.coalesce("rationale", F.lit("")), 1, 300))
    examples = done.select("reg_id", text.alias("input_text"), back.alias("is_relevant"), F.when(back, "user_correction").otherwise("user_decision").alias("origin"), F.when(back, 2.0).otherwise(1.0).alias("weight"))
    events = done.select("reg_id", F.when(back, "irrelevant_overridden").otherwise("irrelevant_confirmed").alias("event_type"))
    all_ = records.join(done.select("reg_id", "verdict"), "reg_id", "left")
    taken = F.coalesce(back, F.lit(False))
    changed = {
        "is_relevant": F.when(taken, True).otherwise(F.col("is_relevant")),
        "processing_status": F.when(taken, "RELEVANT").otherwise(F.col("processing_status")),
        "detected_at": F.when(taken, now).otherwise(F.col("detected_at")),
        "ai_attempts": F.when(taken, 0).otherwise(F.col("ai_attempts")),
        "reviewed": F.col("reviewed") | F.col("verdict").isNotNull(),
    }
    return all_.withColumns(changed).select(*records.columns), examples, events
