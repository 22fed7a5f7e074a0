"""Cross-entropy difference of matched bigram models.

Two models are counted over the corpus: one from the target documents, one
from all.  Both have the same order, smoothing and vocabulary (every word of the
whole corpus), so the difference of their losses per token says how much a text
is like the target:  ``difference = H_target - H_background`` in bits, lower is
closer.

    p(w | v) = (c(v, w) + mu * p(w)) / (c(v) + mu),   p(w) = (c(w) + 1) / (N + V)

Counts grow with the corpus and are never sent to all tasks.  Documents are cut
into pages of bounded size.  A page knows each of its distinct words and bigrams
by a hash of 64 bits, and asks for them once, in packed rows: the range of hashes
is cut into buckets, each of which adds up the counts of all pages and tells each
page its sums.  Then the page's documents are scored.  A bigram that stands in
every text is one number a page.  That any two of n different words or bigrams
share a hash, and so their counts, has a chance of about n * n / 2**65: 3e-4 at
n = 1e8, and a handful of pairs at n = 1e10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, staged, text_of

#: Target ids sent to all tasks at most; more are joined by shuffle.
_SENT = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands before a text's first word.
_START = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=1))


@dataclass(frozen=True)
class Matched:
    """mu: weight of the unigram model; page_tokens: about how many tokens a page or bucket has."""

    mu: float = 50.0
    page_tokens: int = 4_000_000


class _Numbers(dict):
    """Word -> its number in the page, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, the bytes of like weight together, compressed."""
    raw = np.ascontiguousarray(values, "<u8").view("u1").reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(8, n).T).view("<u8").ravel()


def _asked(codes: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each bucket: steps from each code to the next, then each row of counts; ``codes`` ascend."""
    cuts = np.searchsorted(codes, edges).tolist()
    return [_packed(np.concatenate([np.diff(codes[a:b], prepend=np.uint64(0)), *counts[:, a:b].astype(np.uint64)])) for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True)]


def _edges(buckets: int) -> np.ndarray:
    """The least code of each bucket."""
    return np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)


def bigrams_of(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each token and the one before it; ``size`` stands before the first."""
    return np.append(np.int64(size), ids[:-1].astype(np.int64)) * (size + 1) + ids if len(ids) else np.empty(0, np.int64)


def _pair_codes(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of bigrams, given as numbers of :func:`bigrams_of` and the hashes of the page's words."""
    before, word = np.divmod(pairs, len(words) + 1)
    code = (np.append(words, _START)[before] * _ODD + words[word]) * _ODD
    return code ^ code >> np.uint64(32)


def _pages(docs: DataFrame, buckets: int, limit: int) -> DataFrame:
    """Documents (page, doc_id, ids, n_tokens) as the page's word numbers, the page's hashes (bucket -1), and what it asks of each bucket.

    ``docs``: doc_id, text, target.  Asked: words with how often each stands,
    and stands before another word, and bigrams with how often each stands; all
    of these in all documents and in target documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, number, size, edges = TaskContext.get().partitionId() << 32, [], _Numbers(), 0, _edges(buckets)

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array([page] * n, pa.int64()), *arrays], ["page", *kinds])

        def flush() -> Iterator[pa.RecordBatch]:
            codes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            yield rows(doc_id=[i for i, _, _ in held], ids=[x.tobytes() for _, x, _ in held], n_tokens=[len(x) for _, x, _ in held], target=[t for *_, t in held])
            yield rows(bucket=[-1], words=[codes.tobytes()])
            words, pairs = np.zeros((4, len(number)), np.int64), None
            for at, some in enumerate(([x for _, x, _ in held], [x for _, x, t in held if t])):
                if not some:
                    continue
                words[at] = np.bincount(np.concatenate(some), minlength=len(number))
                words[at + 2] = np.bincount(np.concatenate([x[:-1] for x in some]), minlength=len(number))
                own, n = np.unique(np.concatenate([bigrams_of(x, len(number)) for x in some]), return_counts=True)
                if pairs is None:
                    grams, pairs = own, np.stack([n, np.zeros_like(n)])
                else:
                    pairs[1, np.searchsorted(grams, own)] = n
            order, gram_codes = np.argsort(codes), _pair_codes(grams, codes)
            gram_order = np.argsort(gram_codes)
            yield rows(bucket=range(buckets), words=_asked(codes[order], words[:, order], edges), pairs=_asked(gram_codes[gram_order], pairs[:, gram_order], edges))

        for batch in batches:
            kinds = {"doc_id": batch.schema.field("doc_id").type, "ids": pa.binary(), "n_tokens": pa.int64(), "target": pa.bool_(), "bucket": pa.int32(), "words": pa.binary(), "pairs": pa.binary()}
            for name, text, target in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), batch.column("target").to_pylist(), strict=True):
                words = text.lower().split()
                held.append((name, np.fromiter(map(number.__getitem__, words), "<u4", len(words)), target))
                size += len(words)
                if size >= limit:
                    yield from flush()
                    page, held, number, size = page + 1, [], _Numbers(), 0
        if held:
            yield from flush()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"page long, doc_id {id_type}, ids binary, n_tokens long, target boolean, bucket int, words binary, pairs binary")


def _summed(asked: list[bytes], n_counts: int) -> tuple[int, list[bytes]]:
    """How many codes there are, and each page's sums over all pages, in the order asked."""
    tables = [_unpacked(x).reshape(1 + n_counts, -1) for x in asked]
    found, at = np.unique(np.concatenate([np.cumsum(t[0], dtype=np.uint64) for t in tables]), return_inverse=True)
    sums = np.stack([np.bincount(at, np.concatenate([t[k] for t in tables]), len(found)).astype(np.int64) for k in range(1, 1 + n_counts)])
    ends = np.cumsum([t.shape[1] for t in tables])[:-1]
    return len(found), [_packed(sums[:, x].ravel()) for x in np.split(at, ends)]


def _told(asked: DataFrame) -> DataFrame:
    """page, bucket and both answers; ``fresh`` adds up to the number of all distinct words."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, words = _summed(list(rows["words"]), 4)
        _, pairs = _summed(list(rows["pairs"]), 2)
        return pd.DataFrame({"page": rows["page"], "bucket": rows["bucket"], "words": words, "pairs": pairs, "fresh": [n] + [0] * (len(rows) - 1)})

    return asked.groupBy("bucket").applyInPandas(run, "page long, bucket int, words binary, pairs binary, fresh long")


def _sums(told: pd.Series, n_counts: int, codes: np.ndarray) -> np.ndarray:
    """The answers of all buckets, in the order of ``codes``."""
    out = np.zeros((n_counts, len(codes)))
    if len(codes):
        out[:, np.argsort(codes)] = np.concatenate([_unpacked(x).reshape(n_counts, -1) for x in told], 1)
    return out


def score_documents(docs: DataFrame, target: DataFrame, setup: Matched = Matched()) -> DataFrame:
    """Rows (doc_id, n_tokens, h_target, h_background, difference), one for each row of ``docs``.

    ``target``: the ids (doc_id) of target documents; repeated and null ids
    don't matter.  Words are lower-case (A-Z), parted by ASCII white space.  A
    null, empty or wordless text has losses of 0; texts of any length are
    scored whole.  With no target document its model is uniform.  Rows of one
    id, equal or not, are scored and counted one by one, and rows without id are
    background.  Other columns are ignored, whatever their names.  An empty
    table gives no row.
    """
    goal = target.where("doc_id is not null").select("doc_id").distinct().withColumn("goal", F.lit(True))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / 6 / setup.page_tokens))
    few = goal.limit(_SENT + 1).count() <= _SENT
    flagged = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(goal) if few else goal, "doc_id", "left").select("doc_id", "text", F.coalesce("goal", F.lit(False)).alias("target"))
    pages = staged(_pages(flagged, buckets, setup.page_tokens), "pages")
    coded = pages.where("bucket is null").select(F.col("page").alias("of"), "doc_id", "ids", "n_tokens")
    told = staged(_told(pages.where("bucket >= 0").select("page", "bucket", "words", "pairs")), "told")

    size = told.agg(F.sum("fresh")).first()[0] or 0
    own = lambda x: F.coalesce(F.sum(F.when(F.col("target"), x)), F.lit(0))
    some = (F.col("n_tokens") > 0).cast("long")
    tokens, target_tokens, starts, target_starts = pages.where("n_tokens is not null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), own(F.col("n_tokens")), F.coalesce(F.sum(some), F.lit(0)), own(some)).first()
    tokens, starts = np.array([[target_tokens], [tokens]]), np.array([[target_starts], [starts]])

    def losses(own: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("bucket").to_pandas()
        codes, told, lengths = np.frombuffer(told["words"].iloc[0], np.uint64), told[1:], own["n_tokens"].to_numpy()
        facts = _sums(told["words"], 4, codes)
        each = np.concatenate([bigrams_of(np.frombuffer(x, "<u4"), len(codes)) for x in own["ids"].to_pylist()])
        grams, at = np.unique(each, return_inverse=True)
        both = _sums(told["pairs"], 2, _pair_codes(grams, codes))[::-1]
        v, w = np.divmod(grams, len(codes) + 1)
        words, befores = facts[[1, 0]], np.append(facts[[3, 2]], starts, 1)
        uni = (words[:, w] + 1) / (tokens + size)
        bits = -np.log2((both + setup.mu * uni) / (befores[:, v] + setup.mu))
        h = np.zeros((2, len(lengths)))
        full = lengths > 0
        if full.any():
            fronts = (np.cumsum(lengths) - lengths)[full]
            for k in range(2):
                h[k, full] = np.add.reduceat(bits[k][at], fronts) / lengths[full]
        return pa.table({"doc_id": own["doc_id"], "n_tokens": own["n_tokens"], "h_target": h[0], "h_background": h[1], "difference": h[0] - h[1]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, n_tokens long, h_target double, h_background double, difference double"
    answers = told.select("page", "bucket", "words", "pairs").union(pages.where("bucket = -1").select("page", "bucket", "words", "pairs"))
    return coded.groupBy("of").cogroup(answers.groupBy("page")).applyInArrow(losses, kinds)
