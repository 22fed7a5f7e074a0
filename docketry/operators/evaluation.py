"""Evaluation of decisions: confusion counts, sweeps, strata and comparisons of two systems."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import mcnemar_p, rate, wilson

THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6)


def confusion(predicted: Column, expected: Column) -> dict[str, Column]:
    """Counts over rows where both are known."""
    return {
        "tp": F.count_if(predicted & expected),
        "fp": F.count_if(predicted & ~expected),
        "fn": F.count_if(~predicted & expected),
        "tn": F.count_if(~predicted & ~expected),
    }


def decide(threshold: Column) -> Column:
    """A record passes by score, by doubt, or by half the score where it has no text; a null score counts as 0."""
    score = F.coalesce("score", F.lit(0.0))
    return (score >= threshold) | F.col("uncertain") | (~F.col("has_text") & (score >= threshold / 2))


def threshold_sweep(items: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Confusion counts and measures at each threshold; undefined recall and precision are 1, f1 is 0."""
    each = items.where("expected is not null").select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    counts = each.groupBy("threshold").agg(*[v.alias(k) for k, v in confusion(decide(F.col("threshold")), F.col("expected")).items()])
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(1.0))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return counts.select("*", F.round(recall, 3).alias("recall"), F.round(precision, 3).alias("precision"), F.round(f1, 3).alias("f1"))


def ordinal_accuracy(items: DataFrame) -> DataFrame:
    """How often a severity is exact, and within one rank."""
    apart = F.abs(F.col("severity") - F.col("severity_expected"))
    return items.agg(F.count("*").alias("n"), F.round(F.avg((apart == 0).cast("int")), 3).alias("exact"), F.round(F.avg((apart <= 1).cast("int")), 3).alias("near"))


def _sides(items: DataFrame) -> DataFrame:
    """A row for each item and side."""
    return items.select("*", F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("a").alias("result")), F.struct(F.lit("B").alias("side"), F.col("b").alias("result")))).alias("_s")).select("*", "_s.*").drop("_s")


def side_metrics(items: DataFrame) -> DataFrame:
    """Confusion counts of both sides; rates are null where undefined."""
    counts = _sides(items).where("result is not null and expected is not null").groupBy("side").agg(*[v.alias(k) for k, v in confusion(F.col("result"), F.col("expected")).items()])
    return counts.select("*", rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def strata_summary(items: DataFrame) -> DataFrame:
    """By stratum and side: how many are called relevant, with an interval; and how many changed from A to B."""
    counts = _sides(items).groupBy("stratum", "side").agg(
        F.count("*").alias("total"),
        F.count("result").alias("n"),
        F.count_if(F.col("result")).alias("relevant"),
        F.count_if(~F.col("a") & F.col("b")).alias("gained"),
        F.count_if(F.col("a") & ~F.col("b")).alias("lost"),
    )
    low, high = wilson(F.col("relevant"), F.col("n"))
    return counts.select("*", rate(F.col("relevant"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def significance(items: DataFrame) -> DataFrame:
    """Items that one side alone has right, and the exact p."""
    right = [F.col(x) == F.col("expected") for x in ("a", "b")]
    counts = items.where("a is not null and b is not null and expected is not null").agg(F.count_if(right[0] & ~right[1]).alias("a_only"), F.count_if(~right[0] & right[1]).alias("b_only"))
    return counts.withColumn("p", mcnemar_p(F.col("a_only"), F.col("b_only")))


def weighted_precision(items: DataFrame, populations: DataFrame) -> DataFrame:
    """Precision of both sides with sampled strata (stratum, population) grown to their populations."""
    known = _sides(items).where("result is not null and expected is not null")
    sampled = Window.partitionBy("side", "stratum")
    sized = known.withColumn("n", F.count("*").over(sampled)).join(F.broadcast(populations), "stratum", "left")  # one row a stratum
    weight = F.coalesce(F.col("population") / F.col("n"), F.lit(1.0))
    weighed = sized.where("result").groupBy("side").agg(F.sum(weight).alias("predicted"), F.sum(weight * F.col("expected").cast("int")).alias("right"))
    return weighed.select("side", F.round(F.col("right") / F.col("predicted"), 3).alias("precision"))


def what_if(items: DataFrame, old: float, new: float) -> DataFrame:
    """What another threshold would change."""
    was, will = decide(F.lit(old)), decide(F.lit(new))
    return items.agg(F.count_if(was).alias("before"), F.count_if(will).alias("after"), F.count_if(~was & will).alias("gained"), F.count_if(was & ~will).alias("lost"))


def stratified_sample(items: DataFrame, per_stratum: int, seed: str) -> DataFrame:
    """The first rows of each stratum by digest of seed and id: a sampling operator that any engine can repeat."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_draw", "doc_id"))
    return items.withColumn("_draw", draw).withColumn("place", place).where(F.col("place") <= per_stratum).select("stratum", "doc_id", F.col("place").cast("long").alias("place"))


def issuer_summary(items: DataFrame, key: str) -> DataFrame:
    """Found, missed and extra decisions of side A by a key."""
    counts = items.groupBy(key).agg(
        F.count_if(F.col("expected")).alias("expected"),
        F.count_if(F.col("expected") & F.col("a")).alias("found"),
        F.count_if(F.col("expected") & ~F.coalesce("a", F.lit(False))).alias("missed"),
        F.count_if(F.coalesce(~F.col("expected"), F.lit(False)) & F.col("a")).alias("extra"),
    )
    return counts.select("*", rate(F.col("found"), F.col("expected")).alias("recall"), rate(F.col("found"), F.col("found") + F.col("extra")).alias("precision"))


def exclusive_quantile(values: Column, share: float, least: int = 10) -> Column:
    """The quantile at place share * (n + 1), between the two values around it; null for fewer than ``least`` values.

    ``values``: a sorted array, so for groups of bounded size.
    """
    n = F.size(values)
    place = share * (n + 1)
    low = F.greatest(F.least(F.floor(place), n - 1), F.lit(1)).cast("int")
    return F.when(n >= least, F.get(values, low - 1) + (place - low) * (F.get(values, low) - F.get(values, low - 1)))


def frozen_settings(settings: dict[str, object], keys: tuple[str, ...], knowledge: dict[str, str], version: str) -> dict[str, object]:
    """The settings that a comparison runs under, as they are now, and the version of what the model is told (with a digest of its texts)."""
    told = hashlib.sha256("\n".join(f"{k}:{knowledge[k]}" for k in sorted(knowledge)).encode()).hexdigest()[:8]
    return {k: settings[k] for k in keys} | {"knowledge_version": f"{version}+{told}"}


def context_hash(context: list[Column], frozen: dict[str, object]) -> Column:
    """A digest of all that an answer depends on: the record's own columns in the order given, and the frozen settings; equal hashes may share an answer."""
    values = F.struct(*context, F.lit(json.dumps(frozen, ensure_ascii=False, sort_keys=True, default=str)).alias("settings"))
    return F.sha2(F.to_json(values, {"ignoreNullFields": "false"}), 256)
