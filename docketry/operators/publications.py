"""A record's publications: which sources it has, which document speaks for it, what is shown of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Links have reg_id, doc_id, source, role, gazette, url, title, n_text.
#: Fixed value: a gazette text of fewer characters is a stub and doesn't go before others.
LEAST_GAZETTE_TEXT = 300


def _is_main() -> Column:
    return F.col("role") != "attachment"


def source_info(links: DataFrame) -> DataFrame:
    """reg_id, its sources in order, and the address to show: of a main document, any before the gazette's, then the oldest."""
    best = F.min(F.when(_is_main() & F.col("url").isNotNull(), F.struct("gazette", "doc_id", "url")))
    return links.groupBy("reg_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), best["url"].alias("url"))


def primary_url(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """reg_id and url: the summary's own link (``chosen``: reg_id, link), else the gazette's first, else the oldest document's."""
    first = links.where("url is not null").groupBy("reg_id").agg(F.min(F.struct(~F.col("gazette"), "doc_id", "url"))["url"].alias("first"))
    both = first.join(chosen.select("reg_id", "link"), "reg_id", "full")
    return both.select("reg_id", F.coalesce("link", "first").alias("url"))


def primary_document(links: DataFrame, cited: DataFrame) -> DataFrame:
    """reg_id, doc_id: the document cited most, ties to the oldest; without citations one with text, the gazette's, the oldest."""
    counts = cited.groupBy("reg_id", "doc_id").agg(F.count("*").alias("n"))
    mode = counts.groupBy("reg_id").agg(F.min(F.struct(-F.col("n"), "doc_id"))["doc_id"].alias("most"))
    plain = links.where(_is_main()).groupBy("reg_id").agg(F.min(F.struct(F.col("n_text") == 0, ~F.col("gazette"), "doc_id"))["doc_id"].alias("plain"))
    return plain.join(mode, "reg_id", "left").select("reg_id", F.coalesce("most", "plain").alias("doc_id"))


def primary_text(links: DataFrame) -> DataFrame:
    """The oldest main document of each record."""
    return links.where(_is_main()).groupBy("reg_id").agg(F.min("doc_id").alias("doc_id"))


def evidence_sources(links: DataFrame) -> DataFrame:
    """Documents whose text may ground a claim."""
    return links.where("n_text > 0").select("reg_id", "doc_id", "source", "n_text")


def source_links(links: DataFrame) -> DataFrame:
    """reg_id, place from 1, label, url: each address once, at its first place; gazette first, attachments last."""
    rank = F.struct((~_is_main()).alias("late"), (~F.col("gazette")).alias("other"), "doc_id")
    once = links.where("url is not null").groupBy("reg_id", "url").agg(F.min(F.struct(rank.alias("rank"), "role", "gazette", "title")).alias("x"))
    place = F.row_number().over(Window.partitionBy("reg_id").orderBy("x.rank"))
    label = F.when(F.col("x.role") == "attachment", F.concat(F.lit("attachment: "), F.col("x.title"))).when(F.col("x.gazette"), F.lit("gazette")).otherwise(F.col("x.title"))
    return once.select("reg_id", place.alias("place"), label.alias("label"), "url")


def ai_units(suggestions: DataFrame) -> DataFrame:
    """Each unit that the model ever suggested for a record, at its best rank."""
    return suggestions.where("origin = 'ai'").groupBy("reg_id", "unit").agg(F.min("rank").alias("rank"))


def viewed(records: DataFrame, history: DataFrame, actor: str) -> DataFrame:
    seen = history.where((F.col("kind") == "viewed") & (F.col("actor") == actor)).select("reg_id").distinct().withColumn("viewed", F.lit(True))
    return records.select("reg_id").join(seen, "reg_id", "left").select("reg_id", F.coalesce("viewed", F.lit(False)).alias("viewed"))


def model_context(links: DataFrame, longest: int) -> DataFrame:
    """reg_id, main document, all documents in the order shown to a model, other titles, and how much text is cut off at ``longest``."""
    full_gazette = F.col("gazette") & (F.col("n_text") > LEAST_GAZETTE_TEXT)
    main = F.max(F.when(_is_main(), F.struct(full_gazette.alias("g"), "n_text", (-F.col("doc_id")).alias("o"), "title")))
    late = F.array_sort(F.collect_list(F.when(~_is_main(), F.struct("doc_id", "title"))))
    titles = F.array_sort(F.collect_set(F.when(_is_main(), F.col("title"))))
    shown = links.groupBy("reg_id").agg(main.alias("m"), late.alias("late"), titles.alias("titles"), F.sum(F.when(~_is_main(), F.col("n_text")).otherwise(0)).alias("more"))
    order = F.concat_ws(",", (-F.col("m.o")).cast("string"), F.when(F.size("late") > 0, F.array_join(F.transform("late", lambda x: x["doc_id"].cast("string")), ",")))
    others = F.array_join(F.filter("titles", lambda t: ~t.eqNullSafe(F.col("m.title"))), "; ")
    size = F.coalesce("m.n_text", F.lit(0)) + F.col("more")
    return shown.select("reg_id", order.alias("documents"), others.alias("other_titles"), F.greatest(size - longest, F.lit(0)).alias("cut_off"))


def by_source(records: DataFrame, links: DataFrame, sources: list[str]) -> DataFrame:
    """Records with a publication in one of ``sources``."""
    return records.join(links.where(F.col("source").isin(sources)).select("reg_id"), "reg_id", "left_semi")


def edited(records: DataFrame, history: DataFrame) -> DataFrame:
    """Records whose content somebody changed."""
    return records.join(history.where("kind = 'content_edited'").select("reg_id"), "reg_id", "left_semi")


def possible_duplicate(candidates: DataFrame) -> DataFrame:
    """reg_id, its likeliest other record of (reg_id, other, score); ties to the smaller one."""
    return candidates.groupBy("reg_id").agg(F.min(F.struct(-F.col("score"), "other"))["other"].alias("other"), F.max("score").alias("score"))


def documents_of(links: DataFrame) -> DataFrame:
    """reg_id, how many documents, and source:document of each in order."""
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "source")))
    return links.groupBy("reg_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["source"], x["doc_id"].cast("string"))), ",").alias("documents"))


def kept_titles(links: DataFrame, longest: int = 20) -> DataFrame:
    """reg_id and its titles, each once by its folded form in its first spelling, ``longest`` at most (a record's topic list is that long)."""
    first = links.groupBy("reg_id", F.lower("title").alias("folded")).agg(F.min(F.struct("doc_id", "title")).alias("x"))
    place = F.row_number().over(Window.partitionBy("reg_id").orderBy("x.doc_id"))
    return first.withColumn("place", place).where(F.col("place") <= longest).groupBy("reg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "x.title"))), lambda x: x["title"]), "; ").alias("titles"))
