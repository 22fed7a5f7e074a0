"""Relevance by rules and votes, severity rules and unit suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.similarity import partial_of
from docketry.functions.text import flexible, stem_match, tr_lower

SEVERITIES = ("none", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Weights:
    model: float = 0.6
    votes: float = 0.3
    rules: float = 0.1
    threshold: float = 0.4
    high: float = 0.75
    medium: float = 0.45


def rule_signal(priority: Column, text: Column, keywords: list[str]) -> Column:
    """Half the source's priority, half the keywords found, two being enough."""
    low = tr_lower(F.substring(text, 1, 6000))
    hits = sum((F.contains(low, tr_lower(F.lit(k))).cast("int") for k in keywords), F.lit(0))
    return F.round(0.5 * priority + 0.5 * F.least(F.lit(1.0), hits / 2), 4)


def ensemble(votes: DataFrame, w: Weights = Weights()) -> DataFrame:
    """One decision a record from rows (record, relevant, score, uncertain, rules, has_text).

    Split votes or a doubtful majority pass at any score; half the threshold is
    enough where the record has no text.
    """
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    one = votes.groupBy("record").agg(
        F.avg(clamped).alias("model"),
        F.avg(F.col("relevant").cast("int")).alias("ratio"),
        (2 * F.count_if("uncertain") >= F.count("*")).alias("many_doubts"),
        F.bool_or("uncertain").alias("any_doubt"),
        F.max("rules").alias("rules"),
        F.bool_or("has_text").alias("has_text"),
    )
    score = F.round(w.model * F.col("model") + w.votes * F.col("ratio") + w.rules * F.col("rules"), 4)
    split = (F.col("ratio") > 0) & (F.col("ratio") < 1)
    doubt = F.col("many_doubts") & F.col("any_doubt")
    passes = (F.col("total") >= w.threshold) | doubt | split | (~F.col("has_text") & (F.col("total") >= w.threshold / 2))
    unsure = doubt | split | ~F.col("has_text")
    band = F.when(unsure, "low").when(F.col("total") >= w.high, "high").when(F.col("total") >= w.medium, "medium").otherwise("low")
    return one.withColumn("total", score).select("record", F.col("total").alias("score"), passes.alias("relevant"), unsure.alias("uncertain"), band.alias("band"))


@dataclass(frozen=True)
class SeverityRules:
    critical: tuple[str, ...] = ()
    immediate: tuple[str, ...] = ()
    addressed: tuple[str, ...] = ()
    cap_by_type: dict[str, int] = field(default_factory=dict)
    cap_by_title: dict[str, int] = field(default_factory=dict)
    floor: int = 3


def ruled_severity(severity: Column, kind: Column, text: Column, title: Column, rules: SeverityRules) -> Column:
    """A severity's rank raised to the floor by patterns of the text, then held under the lowest cap that applies."""
    low, head = tr_lower(text), tr_lower(title)
    any_of = lambda patterns, edge="": F.coalesce(*[F.when(low.rlike(f"(?U){edge}{flexible(p)}{edge}"), True) for p in patterns], F.lit(False))
    urgent = any_of(rules.critical) | (any_of(rules.immediate) & any_of(rules.addressed, r"\b"))
    raised = F.when(urgent, F.greatest(severity, F.lit(rules.floor))).otherwise(severity)
    caps = [F.when(kind == k, v) for k, v in rules.cap_by_type.items()] + [F.when(head.rlike(f"(?U){p}"), v) for p, v in rules.cap_by_title.items()]
    return F.least(raised, *caps) if caps else raised


def keyword_units(documents: DataFrame, keywords: dict[str, list[str]], most: int = 6) -> DataFrame:
    """Of each document the units with most keywords by stem, in the given order on ties."""
    words = F.regexp_extract_all(tr_lower("text"), F.lit(r"(?U)(\w+)"), 1)
    worded = documents.select("doc_id", words.alias("w"))
    hits = [F.struct((-sum((stem_match(k, "w").cast("int") for k in keys), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(unit).alias("unit")) for i, (unit, keys) in enumerate(keywords.items())]
    best = F.slice(F.array_sort(F.filter(F.array(*hits), lambda x: x["n"] < 0)), 1, most)
    return worded.select("doc_id", F.explode(best).alias("u")).select("doc_id", F.col("u.unit").alias("unit"), (-F.col("u.n")).cast("long").alias("hits"))


def gated_suggestions(raw: DataFrame, responsibilities: DataFrame, least_score: float = 0.3, least_likeness: float = 80.0, most: int = 4) -> DataFrame:
    """Suggestions that survive, or why not.

    ``raw``: record, unit, score, claim, areas; ``responsibilities``: unit,
    duty, unit_areas.  Of a unit's suggestions the best counts; units whose
    areas share none with the record's, low scores and claims unlike any duty
    are dropped; of what is left the ``most`` best are kept.
    """
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("record", "unit").orderBy(F.desc("score"), "claim"))
    once = raw.withColumn("_n", first).where("_n = 1").drop("_n")
    both = once.join(responsibilities, "unit").withColumn("likeness", partial_of(tr_lower("claim"), tr_lower("duty")))
    one = both.groupBy("record", "unit", "score").agg(F.max("likeness").alias("likeness"), F.max_by("duty", F.struct("likeness", "duty")).alias("duty"), F.first("areas").alias("areas"), F.first("unit_areas").alias("unit_areas"))
    apart = (F.size("areas") > 0) & (F.size("unit_areas") > 0) & ~F.arrays_overlap("areas", "unit_areas")
    why = F.when(apart, "area").when(F.col("score") < least_score, "score").when(F.col("likeness") < least_likeness, "duty")
    judged = one.withColumn("why", why)
    place = F.row_number().over(Window.partitionBy("record", F.col("why").isNull()).orderBy(F.desc("score"), "unit"))
    return judged.withColumn("place", place).select("record", "unit", "duty", F.when(F.col("why").isNull() & (F.col("place") > most), "full").otherwise(F.col("why")).alias("dropped"))
