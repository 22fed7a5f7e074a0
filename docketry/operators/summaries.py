"""Summaries held against their sources: what no quote bears out is taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.grounding import quote_evidence
from docketry.session import staged


def verified_claims(claims: DataFrame, sources: DataFrame, least: float = 90.0) -> DataFrame:
    """record, kind, place, text, n_quotes, n_found, kept: each claim, and whether any of its quotes is in a source of its record.

    ``claims``: record, kind (sentence or topic), place, text, quotes (a list);
    ``sources``: record, doc_id, text.  Claims without text are left out, those
    without quotes aren't kept.
    """
    own = claims.where("length(trim(text)) > 0").withColumn("item_id", F.monotonically_increasing_id())
    # Written once, so a claim keeps its number.
    own = staged(own, "claims")
    each = own.select("item_id", "record", F.posexplode("quotes").alias("turn", "quote"))
    each = staged(each.withColumn("quote_id", F.monotonically_increasing_id()), "quotes")
    found = quote_evidence(each.select(F.col("quote_id").alias("item_id"), "record", "quote"), sources, least).select(F.col("item_id").alias("quote_id"))
    counts = each.join(found, "quote_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("n_found"))
    n_found = F.coalesce("n_found", F.lit(0))
    quotes = F.greatest(F.size(F.coalesce("quotes", F.array().cast("array<string>"))), F.lit(0))
    return own.join(counts, "item_id", "left").select("record", "kind", "place", F.trim("text").alias("text"), quotes.alias("n_quotes"), n_found.alias("n_found"), (n_found > 0).alias("kept"))


def verified_summaries(verified: DataFrame) -> DataFrame:
    """record, sentences, topics (texts that were kept, in order), removed, grounding (share of all claims that was kept, null without any)."""
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kept") & (F.col("kind") == kind), F.struct("place", "text")))), lambda x: x["text"])
    share = F.round(F.count_if("kept") / F.nullif(F.count("*"), F.lit(0)), 4)
    return verified.groupBy("record").agg(texts("sentence").alias("sentences"), texts("topic").alias("topics"), F.count_if(~F.col("kept")).alias("removed"), share.alias("grounding"))


def current_summaries(summaries: DataFrame) -> DataFrame:
    """Each record's summary in force; of several marked so the newest version."""
    newest = F.max_by(F.struct(*[c for c in summaries.columns if c != "reg_id"]), "version")
    return summaries.where("is_current").groupBy("reg_id").agg(newest.alias("s")).select("reg_id", "s.*")
