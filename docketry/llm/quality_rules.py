"""Quality rules with risk-controlled thresholds.

Every document gets a few one-sided signals (symbols, shouting, repeats ...).
A rule "signal at or over a cutoff: reject" is only put into force where the
labelled documents prove, by an exact binomial test, that it rejects at most a
stated share of good documents of the same stratum.

For each pair of stratum and signal the cutoffs of a fixed grid are tested
from lax to strict (fixed-sequence testing, which needs no correction); the
pairs share the error level by Bonferroni's correction.  So with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents.
Among proven cutoffs the one that rejects most bad documents is used, the
laxest on a tie; a rule that rejects no bad document stays off.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from .common import staged, trim_memory

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
_COUNTS = StructType([StructField(name, LongType()) for name in MEASURES])
_SPACE = b" \t\n\r\x0b\x0c"
_SPACES = {ord(c): None for c in " \t\n\r\x0b\x0c"}
_UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class RiskRules:
    """alpha: most good documents of a stratum that may be rejected; delta: chance
    that this fails; bins: cutoffs tried for each signal; bands: word counts
    that part the strata."""

    alpha: float = 0.05
    delta: float = 0.05
    bins: int = 64
    bands: tuple[int, ...] = (200, 600)


def measure(text: str) -> tuple[int, ...]:
    """Counts of one whole text, see MEASURES; words are runs without ASCII white space."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)] if raw else []
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (
        len(words),
        len(text.translate(_SPACES)) if not text.isascii() else len(raw.translate(None, _SPACE)),
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
        raw.count(b"!") + raw.count(b"?"),
    )


@pandas_udf(_COUNTS)
def measures(texts: pd.Series) -> pd.DataFrame:
    rows = [measure(x or "") for x in texts]
    trim_memory()
    return pd.DataFrame(rows, columns=list(MEASURES), dtype="int64")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def signals() -> dict[str, Column]:
    """Each from 0 to 1, higher is worse."""
    odds = lambda x: x / (1 + x)
    return {
        "symbols": odds(_share("n_symbols", "n_words")),
        "repeats": _share("n_repeat_words", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "upper": _share("n_upper", "word_chars"),
        "exclaim": odds(_share("n_exclaim", "n_words")),
    }


def _binned(rules: RiskRules) -> dict[str, Column]:
    return {k: F.least(F.floor(v * rules.bins), F.lit(rules.bins - 1)).cast("int") for k, v in signals().items()}


def _stratum(rules: RiskRules) -> Column:
    return sum((F.col("n_words") >= b).cast("int") for b in rules.bands) + F.lit(0)


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoffs(counts: dict[tuple[int, str, int, int], int], rules: RiskRules, names: list[str]) -> dict[tuple[int, str], int]:
    """counts[stratum, signal, quality, bin] -> the cutoff bin of each (stratum, signal) in force."""
    strata = range(len(rules.bands) + 1)
    level, share = rules.delta / (len(strata) * len(names)), rules.alpha / len(names)
    cutoffs = {}
    for s in strata:
        for name in names:
            good = [counts.get((s, name, 1, b), 0) for b in range(rules.bins)]
            bad = [counts.get((s, name, 0, b), 0) for b in range(rules.bins)]
            n, lost, caught, best = sum(good), 0, 0, 0
            if not n:
                continue
            for cut in range(rules.bins - 1, 0, -1):
                lost, caught = lost + good[cut], caught + bad[cut]
                if lost >= share * n or tail(lost, n, share) > level:
                    break
                if caught > best:
                    best, cutoffs[s, name] = caught, cut
    return cutoffs


def learn_cutoffs(counted: DataFrame, labels: DataFrame, rules: RiskRules) -> dict[tuple[int, str], int]:
    """Cutoffs in force, from the measures of all labelled documents (columns doc_id and MEASURES)."""
    names = list(signals())
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    binned = counted.select("doc_id", _stratum(rules).alias("stratum"), *[v.alias(k) for k, v in _binned(rules).items()])
    # At most strata x signals x 2 x bins rows.
    tally = binned.join(known, "doc_id").unpivot(["stratum", "quality"], names, "signal", "bin").groupBy("stratum", "signal", "quality", "bin").count()
    counts = {(r["stratum"], r["signal"], r["quality"], r["bin"]): r["count"] for r in tally.collect()}
    return choose_cutoffs(counts, rules, names)


def verdict(cutoffs: dict[tuple[int, str], int], rules: RiskRules) -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` from the measures."""
    bad = F.lit(False)
    for (s, name), cut in sorted(cutoffs.items()):
        bad = bad | ((_stratum(rules) == s) & (_binned(rules)[name] >= cut))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base, ~base & ~bad


def quality_rules(docs: DataFrame, labels: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """All columns of ``docs`` but text, the counts of MEASURES, ``base_failed`` and ``kept``.

    ``labels``: doc_id, quality (1 good, 0 bad).  Labels with a null id or
    quality are ignored; of several labels of one id the lowest counts.  A null
    or empty text has no words and fails the base rule.  Every row of ``docs``
    is judged by itself, so repeated rows get equal results.  Columns of
    ``docs`` named like a result are replaced; without labels no cutoff is in force.
    """
    taken = {*MEASURES, "base_failed", "kept", "text"}
    rest = [c for c in docs.columns if c not in taken]
    counted = staged(docs.select(*rest, measures(F.col("text")).alias("_m")).select(*rest, "_m.*"), "quality")
    base, kept = verdict(learn_cutoffs(counted, labels, rules), rules)
    return counted.withColumn("base_failed", base).withColumn("kept", kept)


def keep_good(docs: DataFrame, labels: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, unchanged.

    Texts are measured once more instead of being shuffled to their verdicts.
    """
    counted = staged(docs.select("doc_id", measures(F.col("text")).alias("_m")).select("doc_id", "_m.*"), "quality")
    kept = verdict(learn_cutoffs(counted, labels, rules), rules)[1]
    own = docs.select(F.struct(*docs.columns).alias("_row"), measures(F.col("text")).alias("_m"))
    return own.select("_row", "_m.*").where(kept).select("_row.*")
