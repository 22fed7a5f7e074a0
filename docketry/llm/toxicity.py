"""Toxicity by logistic regression, learned with FTRL-proximal.

Features are hashed word unigrams, bigrams and skip-grams (gaps of one and two
words), each counted once a document.  FTRL-proximal gives every coordinate its
own rate, and its L1 term keeps most weights at exactly zero, so what is sent
to the tasks is one sparse vector of at most ``2 ** bits`` weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, text_of

_EDGES = b".,;:!?\"'()[]{}|*#-_"


@dataclass(frozen=True)
class Ftrl:
    """train_docs: labelled documents learned from, by lowest hash of the id: the documented bound of the sample."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 10
    train_docs: int = 12_000


class Hashes(dict):
    """Word -> 32-bit hash of its lower-case form without punctuation at its ends; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word.decode("utf-8", "replace").lower().encode().strip(_EDGES))
        return value


def features(text: bytes, hashes: Hashes, bits: int) -> np.ndarray:
    """Distinct feature numbers of a whole text; none for an empty one."""
    words = text.split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found = [h]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        if len(h) > gap:
            found.append((h[:-gap] * np.uint64(odd)) ^ (h[gap:] * np.uint64(0xD6E8FEB86659FD93)))
    mixed = np.concatenate(found) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64))


def fit(rows: list[tuple[np.ndarray, int]], setup: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in the order given."""
    z, n = np.zeros((1 << setup.bits) + 1), np.zeros((1 << setup.bits) + 1)
    bias = 1 << setup.bits

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        step = (setup.beta + np.sqrt(n[at])) / setup.alpha + setup.l2
        return np.where(np.abs(zi) <= setup.l1, 0.0, (np.sign(zi) * setup.l1 - zi) / step)

    for _ in range(setup.epochs):
        for own, label in rows:
            at = np.append(own, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / setup.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(bias + 1))
    return every[:bias].astype(np.float32), float(every[bias])


def train(docs: DataFrame, labels: DataFrame, setup: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (1 or 0; others and null ids are ignored,
    of several labels of an id the highest counts).

    ``train_docs`` labelled ids are learned from at most, by hash of the id: the
    documented bound of the sample.  Several documents of one id are all learned
    from.  Without labels, or documents, all weights are 0.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most train_docs pairs of an id and a label.
    picked = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(setup.train_docs)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [features(x, hashes, setup.bits).astype("<i4").tobytes() for x in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("toxic"), pa.array(found, pa.binary())], ["h", "toxic", "features"])

    compact = sample.select("_h", "toxic", "text").mapInArrow(hashed, "h long, toxic int, features binary")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "features"])
        rows = [(np.frombuffer(x, "<i4").astype(np.int64), y) for x, y in zip(part["features"], part["toxic"], strict=True)]
        w, bias = fit(rows, setup)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at].astype(float), bias)})

    # One task, for the order of updates matters; its input has the bound train_docs.
    model = compact.groupBy().applyInPandas(learn, "at long, w double").toPandas()
    w = np.zeros(1 << setup.bits, np.float32)
    inner = model[model["at"] >= 0]
    w[inner["at"].to_numpy()] = inner["w"].to_numpy()
    return w, float(model.loc[model["at"] < 0, "w"].sum())


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], setup: Ftrl = Ftrl()) -> DataFrame:
    """All columns of ``docs`` but text, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text has no feature and gets the score of the bias alone.
    """
    spark = docs.sparkSession
    w, bias = model
    at = np.flatnonzero(w).astype(np.int32)
    shared = spark.sparkContext.broadcast((at, w[at], bias))
    rest = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    frame = docs.select(*rest, text_of().alias("text"))
    schema = frame.drop("text").schema.add("score", "double").add("predicted", "integer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        dense, hashes = np.zeros(1 << setup.bits, np.float32), Hashes()
        dense[at] = values
        for batch in batches:
            sums = np.array([dense[features(x, hashes, setup.bits)].sum(dtype=np.float64) for x in byte_texts(batch.column("text"))]).reshape(-1) + bias
            p = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    return frame.mapInArrow(score, schema)
