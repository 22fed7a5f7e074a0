"""Language ID by prediction by partial matching over bytes.

Each language has a frozen context tree of order three.  The probability of a
byte after a context is taken from the longest context: ``c / (n + d)`` for a
byte seen ``c`` times among ``n`` (escape method C, ``d`` distinct bytes), else
the escape probability ``d / (n + d)`` times that of the next shorter context,
down to a uniform byte.  The sum of ``-log2`` over a text is its exact code
length, and the language with the shortest code wins.

As the statistics are frozen, the cost of a byte depends on itself and the
three bytes before it only, so trees become one table of costs which all tasks
read; its size is bounded by the bounded training sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, runs_of_bytes, text_of

ORDER = 3
#: Letters, and numbers that aren't decimal digits.
_LETTER_LIKE = re.compile(r"[^\W\d_]")
_PIECE = 1 << 19


@dataclass(frozen=True)
class CostTable:
    """symbol: byte -> symbol; context: three symbols -> row; bits[row * symbols + symbol, language]."""

    languages: tuple[str, ...]
    symbol: np.ndarray
    context: np.ndarray
    bits: np.ndarray

    @property
    def n_symbols(self) -> int:
        return round(len(self.context) ** (1 / 3))


def _with_start(text: bytes) -> bytes:
    return b"\0" * ORDER + text


def count_grams(texts: list[bytes]) -> pd.DataFrame:
    """Distinct strings of four bytes, with the padding before each text, and how often they occur."""
    grams, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for text in texts:
        x = np.frombuffer(_with_start(text), np.uint8).astype(np.uint32)
        own, n = np.unique(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:], return_counts=True)
        grams, inverse = np.unique(np.concatenate([grams, own]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return pd.DataFrame({"gram": grams.astype(np.int64), "n": counts})


def build_costs(grams: pd.DataFrame) -> CostTable:
    """From rows (lang, gram, n): four bytes as an integer and their count in a language."""
    languages = tuple(sorted(grams["lang"].unique()))
    which = np.searchsorted(np.array(languages, object), grams["lang"].to_numpy(object))
    parts = np.stack([grams["gram"].to_numpy() >> s & 255 for s in (24, 16, 8, 0)])
    seen = np.unique(np.append(parts, 0))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)  # 0: never seen
    a = len(seen) + 1
    s0, s1, s2, s3 = symbol[parts]
    n = grams["n"].to_numpy(np.float64)
    k = len(languages)
    uniform = np.full((1, a, k), 1 / 257)

    def refine(rows: np.ndarray, n_rows: int, shorter: np.ndarray) -> np.ndarray:
        """Probabilities by row from the counts, backing off to those of the shorter contexts."""
        c = np.zeros((n_rows, a, k))
        np.add.at(c, (rows, s3, which), n)
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        size = np.maximum(total + distinct, 1)
        return np.where(c > 0, c / size, np.where(total > 0, distinct / size, 1.0) * shorter)

    p0 = refine(np.zeros(len(n), int), 1, uniform)
    p1 = refine(s2, a, p0)
    pairs, at2 = np.unique(s1 * a + s2, return_inverse=True)
    p2 = refine(at2, len(pairs), p1[pairs % a])
    triples, at3 = np.unique((s0 * a + s1) * a + s2, return_inverse=True)
    p3 = refine(at3, len(triples), p2[np.searchsorted(pairs, triples % (a * a))])
    context = np.tile(np.arange(a, dtype=np.int32), a)
    context[pairs] = a + np.arange(len(pairs))
    context = np.tile(context, a)
    context[triples] = a + len(pairs) + np.arange(len(triples))
    bits = -np.log2(np.concatenate([p1, p2, p3])).astype(np.float32)
    return CostTable(languages, symbol, context, bits.reshape(-1, k))


def code_lengths(texts: list[bytes], costs: CostTable) -> np.ndarray:
    """Bits of each text under each language; long texts are summed piece by piece."""
    a, out = costs.n_symbols, np.zeros((len(texts), len(costs.languages)))

    def bits(padded: bytes) -> np.ndarray:
        x = costs.symbol[np.frombuffer(padded, np.uint8)]
        return costs.bits[costs.context[(x[:-3] * a + x[1:-2]) * a + x[2:-1]] * a + x[3:]]

    for lo, hi in runs_of_bytes(texts, _PIECE):
        if hi - lo == 1 and len(texts[lo]) > _PIECE:
            padded = _with_start(texts[lo])
            for at in range(0, len(texts[lo]), _PIECE):
                out[lo] += bits(padded[at : at + _PIECE + ORDER]).sum(0, dtype=np.float64)
            continue
        some = [i for i in range(lo, hi) if texts[i]]
        if some:
            each = bits(b"".join(_with_start(texts[i]) for i in some))
            ends = np.cumsum([len(texts[i]) + ORDER for i in some])
            starts = ends - [len(texts[i]) + ORDER for i in some]
            sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(each, 0, dtype=np.float64)])
            # The last three windows before the next text belong to no text.
            out[some] = sums[ends - ORDER] - sums[starts]
    return out


def train(docs: DataFrame, train_docs: int = 300) -> CostTable | None:
    """From rows with text and lang.

    ``train_docs``: whole documents of each language that are learned from, by
    lowest hash: the documented bound of the sample.  Rows without lang or text
    are ignored.  Equal rows share a hash and may all be in the sample or, but for
    a language's lowest hash, all out of it, so every language is learned.  None
    if nothing remains.
    """
    key = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    rows = docs.where("lang is not null and text is not null").select("lang", "text", key.alias("_h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("_h").alias("_least"))
    # Thin out by hash first, so that no language is sorted whole in one task.
    share = F.least(F.lit(1.0), 2.0 * train_docs / F.col("count"))
    thin = rows.join(F.broadcast(sizes), "lang").where((F.pmod(F.col("_h"), F.lit(1 << 20)) <= share * (1 << 20)) | (F.col("_h") == F.col("_least")))
    first = Window.partitionBy("lang").orderBy("_h", "text")
    sample = thin.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= train_docs)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = count_grams([x.encode("utf-8", "replace") for x in part["text"]])
        return out.assign(lang=part["lang"].iloc[0])[["lang", "gram", "n"]]

    grams = sample.select("lang", "text").groupBy("lang").applyInPandas(count, "lang string, gram long, n long").toPandas()
    return build_costs(grams) if len(grams) else None


def predict_languages(docs: DataFrame, costs: CostTable | None) -> DataFrame:
    """All columns of ``docs`` but text, ``lang_pred`` and ``score``.

    A null text, or one without a letter, is ``und`` with score 0 (signs such as
    a half or a Roman eight are numbers, not letters); so is every text if no
    language was learned.  Texts of any length are judged whole, long ones piece
    by piece; repeated rows are judged one by one.  ``score`` is the posterior probability of
    the winner under equal priors; on a tie the first language by name wins.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    shared = spark.sparkContext.broadcast(costs)
    frame = docs.select(*rest, text_of().alias("text"))
    schema = frame.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            if table is None:
                names, best = np.full(len(texts), "und", object), np.zeros(len(texts))
            else:
                bits = code_lengths(texts, table)
                win = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                names, best = np.array(table.languages, object)[win], 1 / odds.sum(1)
                silent = [i for i, x in enumerate(texts) if not any(m[0].isalpha() for m in _LETTER_LIKE.finditer(x.decode("utf-8", "replace")))]
                names[silent], best[silent] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(best)], [*rest, "lang_pred", "score"])

    return frame.mapInArrow(score, schema)
