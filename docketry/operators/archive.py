"""The archive: every record with what became of it, irrelevant ones included."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import search_fold

from .publications import by_source, source_info

#: The deepest page that is answered, and what a list shows of a rationale.
DEEPEST, PREVIEW = 2000, 320


@dataclass(frozen=True)
class ArchiveQuery:
    tab: str | None = None
    sources: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    text: str | None = None
    page: int = 1
    page_size: int = 20


def tab_of() -> Column:
    return F.when(~F.col("is_relevant"), "irrelevant").when(F.col("review_status") == "pending", "open").otherwise(F.col("review_status"))


def preview(text: Column, longest: int = PREVIEW) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def archived(records: DataFrame, links: DataFrame, q: ArchiveQuery) -> DataFrame:
    """The records that meet all criteria given; text stands in the title or the issuer."""
    rows = records.withColumn("tab", tab_of())
    if q.tab:
        rows = rows.where(F.col("tab") == q.tab)
    if q.since:
        rows = rows.where(F.col("publish_date") >= F.lit(q.since).cast("date"))
    if q.until:
        rows = rows.where(F.col("publish_date") <= F.lit(q.until).cast("date"))
    if q.text:
        word = search_fold(F.lit(q.text))
        rows = rows.where(search_fold("title").contains(word) | search_fold("issuer").contains(word))
    return by_source(rows, links, list(q.sources)) if q.sources else rows


def archive_page(records: DataFrame, links: DataFrame, q: ArchiveQuery) -> DataFrame:
    """One page, newest publication first; sources are looked up for the page's records alone."""
    if not 1 <= q.page <= DEEPEST:
        raise ValueError(f"pages from 1 to {DEEPEST} are answered")
    order = [F.col("publish_date").desc_nulls_last(), F.desc("reg_id")]
    page = archived(records, links, q).orderBy(*order).offset((q.page - 1) * q.page_size).limit(q.page_size)
    own = links.join(page.select("reg_id"), "reg_id", "left_semi")
    return page.join(source_info(own), "reg_id", "left")


def unreviewed_irrelevant(records: DataFrame, history: DataFrame, text: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """Irrelevant records that nobody has confirmed or overruled, the likeliest to be relevant first."""
    rows = records.where(~F.col("is_relevant")).join(history.where("kind = 'decided'").select("reg_id"), "reg_id", "left_anti")
    if text:
        rows = rows.where(search_fold("title").contains(search_fold(F.lit(text))))
    return rows.orderBy(F.col("score").desc_nulls_last(), F.desc("reg_id")).offset((page - 1) * page_size).limit(page_size)


def filtered_out(records: DataFrame, since: str, until: str, most: int = 500) -> DataFrame:
    """What the model called irrelevant in a period, best score first."""
    within = F.col("publish_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return records.where(~F.col("is_relevant") & within).orderBy(F.desc("score"), F.desc("reg_id")).limit(most)


def find_records(records: DataFrame, text: str, most: int = 30) -> DataFrame:
    """Records with ``text`` in title, issuer or id, newest first."""
    word = F.lower(F.lit(text))
    held = F.lower("title").contains(word) | F.lower("issuer").contains(word) | (F.col("reg_id").cast("string") == word)
    return records.where(held).orderBy(F.desc("reg_id")).limit(most)


def export(ordered: DataFrame, most: int = 5000) -> DataFrame:
    """An ordered list as far as a sheet goes, with the number of all rows beside it."""
    total = ordered.groupBy().agg(F.count("*").alias("total"))
    return ordered.limit(most).crossJoin(F.broadcast(total))
