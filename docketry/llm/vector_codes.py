"""Codes of vectors: each of a vector's parts by the nearest entry of that part's codebook.

Components are whole numbers, so sums, entries and distances are exact and don't
depend on how rows are spread.  A codebook (256 entries a part) is the model: it
goes to the driver as sums, is broadcast as kd-trees, and doesn't grow with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, most_common_size, staged, vector_rows

#: Vectors that are searched for together.
_BLOCK = 4096


@dataclass(frozen=True)
class CodeRules:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    leaf: int = 16


@dataclass
class Node:
    """A box around some entries of a codebook, and either two smaller ones or the entries by rising index."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    points: np.ndarray | None = None
    halves: list[Node] = field(default_factory=list)


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None, leaf: int = 16) -> Node:
    """Entries are halved at the median of the widest dimension until ``leaf`` are left."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    node = Node(own.min(0), own.max(0))
    wide = node.high - node.low
    if len(index) <= leaf or not wide.size or not wide.max():
        node.index, node.points = index, own
        return node
    order = index[np.argsort(own[:, int(wide.argmax())], kind="stable")]
    node.halves = [kd_tree(entries, np.sort(half), leaf) for half in (order[: len(order) // 2], order[len(order) // 2 :])]
    return node


def nearest(root: Node, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, ties to the lower index.

    Branch and bound for a block of parts at once: each goes into its nearer
    child first, and a box is left out only if it is farther than the best
    entry so far.  A box just as far is visited, for it may hold a lower index.
    """
    best = np.full(len(parts), np.iinfo(np.int64).max if parts.dtype == np.int64 else np.inf, parts.dtype)
    at = np.full(len(parts), np.iinfo(np.int64).max)

    def reach(node: Node, some: np.ndarray) -> np.ndarray:
        own = parts[some]
        out = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        return np.einsum("nd,nd->n", out, out)

    def visit(node: Node, some: np.ndarray) -> None:
        if node.index is not None:
            gap = parts[some][:, None, :] - node.points[None]
            far = np.einsum("nkd,nkd->nk", gap, gap)
            one = far.argmin(1)
            d, i = far[np.arange(len(some)), one], node.index[one]
            win = (d < best[some]) | (d == best[some]) & (i < at[some])
            best[some[win]], at[some[win]] = d[win], i[win]
            return
        a, b = (reach(half, some) for half in node.halves)
        for first, near, far in ((0, a <= b, b), (1, a > b, a)):
            if near.any():
                visit(node.halves[first], some[near])
                left, bound = some[near], far[near]
                left = left[bound <= best[left]]
                if len(left):
                    visit(node.halves[1 - first], left)

    if len(parts):
        visit(root, np.arange(len(parts)))
    return at, best


def _whole(batch: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch's vectors, in the narrowest type in which every distance is exact."""
    x = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)
    most = max(1.0, float(np.abs(x).max(initial=0)))
    if 4 * most * most * width < 2**53:
        return x
    if 4 * most * most * width < 2**63:
        return x.astype(np.int64)
    raise ValueError(f"a component of {most / scale:g} is too large: squared distances have to fit a long")


def _blocks(whole: np.ndarray, parts: int) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(whole), _BLOCK):
        rows = slice(start, min(start + _BLOCK, len(whole)))
        yield rows, whole[rows].reshape(rows.stop - start, parts, -1)


def _trees(codebooks: list[np.ndarray], like: np.ndarray, leaf: int) -> list[Node]:
    """Trees in the type of a batch; entries lie between the vectors' least and largest components, so they fit as well."""
    most = max((int(np.abs(c).max(initial=0)) for c in codebooks), default=0)
    wide = 4 * most * most * like.shape[1] >= 2**53
    return [kd_tree(c.astype(np.int64 if wide else like.dtype), leaf=leaf) for c in codebooks]


def _search(rows: DataFrame, codebooks: list[np.ndarray], rules: CodeRules):
    """A function that gives each batch's whole numbers, and for each part the indexes and distances."""
    sent = rows.sparkSession.sparkContext.broadcast((codebooks, [kd_tree(c.astype(np.float64), leaf=rules.leaf) for c in codebooks]))
    width = sum(c.shape[1] for c in codebooks)

    def run(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        books, trees = sent.value
        whole = _whole(batch, width, rules.scale)
        if whole.dtype == np.int64 or max(int(np.abs(c).max(initial=0)) for c in books) ** 2 * 4 * width >= 2**53:
            whole = whole.astype(np.int64)
            trees = _trees(books, whole, rules.leaf)
        for at, block in _blocks(whole, len(books)):
            found = [nearest(tree, np.ascontiguousarray(block[:, p])) for p, tree in enumerate(trees)]
            yield at, block, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return run


def _improved(rows: DataFrame, codebooks: list[np.ndarray], rules: CodeRules) -> list[np.ndarray]:
    """One round: every part to its nearest entry, then every entry that was used to the floor of its parts' mean."""
    search, width = _search(rows, codebooks, rules), codebooks[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), width), np.int64) for c in codebooks]
        count = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for _, block, at, _ in search(batch):
                for p in range(len(codebooks)):
                    order = np.argsort(at[:, p], kind="stable")
                    entries, starts = np.unique(at[order, p], return_index=True)
                    # Components are far below 2**32, so a task's sums fit a long.
                    total[p][entries] += np.add.reduceat(block[order, p], starts, axis=0).astype(np.int64)
                    count[p] += np.bincount(at[:, p], minlength=len(codebooks[p]))
        used = [(p, e) for p in range(len(codebooks)) for e in np.flatnonzero(count[p]).tolist()]
        columns = [[p for p, _ in used], [e for _, e in used], [int(count[p][e]) for p, e in used], [[Decimal(int(s)) for s in total[p][e]] for p, e in used]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "n", "total"])

    own = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<decimal(38,0)>")
    means = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)])
    better = [c.copy() for c in codebooks]
    # At most parts x entries rows, however many vectors there are.
    for r in means.collect():
        better[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return better


def train_codebooks(vectors: DataFrame, rules: CodeRules = CodeRules()) -> list[np.ndarray]:
    """A codebook (entries x components, long) for each part position, learned from all of ``vectors`` (vec_id, embedding).

    Rows that :func:`kept_vectors` drops aren't used; of equal ids the one with
    the smaller vector comes first, and a null id comes last.  With fewer rows
    than entries a codebook has as many as there are rows; none without rows.
    """
    return _trained(kept_vectors(vectors, rules), rules)


def _trained(kept: DataFrame, rules: CodeRules) -> list[np.ndarray]:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(rules.entries).collect()
    if not first or not first[0]["vector"]:
        return []
    whole = np.floor(rules.scale * np.array([r["vector"] for r in first], np.float64)).astype(np.int64)
    codebooks = [np.ascontiguousarray(x) for x in np.split(whole, rules.parts, axis=1)]
    for _ in range(rules.rounds):
        codebooks = _improved(kept, codebooks, rules)
    return codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Digest of all components as decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, rules: CodeRules = CodeRules()) -> DataFrame:
    """vec_id, label and vector of the rows that can be coded.

    Rows whose vector is null or holds null or non-finite components go.  All
    others have to be of one length that the parts divide; where lengths differ,
    those of the most frequent one (of several the longest) stay.
    """
    rows = vector_rows(vectors)
    return most_common_size(rows, "vector", rules.parts)


def vector_codes(vectors: DataFrame, rules: CodeRules = CodeRules()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, a row for each vector that :func:`kept_vectors` keeps.

    ``vectors``: vec_id, embedding and perhaps label; other columns are left
    out.  Repeated rows are coded one by one, equal distances go to the lower
    index, null labels count as one label, and an empty table has an empty
    result.  A component too large for exact squared distances in a long (2**17
    for vectors of 64) is an error.
    """
    kept = staged(kept_vectors(vectors, rules), "vectors")
    codebooks = _trained(kept, rules)
    schema = "vec_id long, label string, code string, error long"
    if codebooks:
        search = _search(kept, codebooks, rules)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, _, index, far in search(batch):
                    text = [bytes(x).hex() for x in index.astype(np.uint8)] if rules.entries <= 256 else ["".join(f"{i:04x}" for i in x) for x in index.tolist()]
                    own = batch.slice(at.start, at.stop - at.start)
                    error = far.sum(1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

        coded = staged(kept.mapInArrow(codes, schema), "codes")
    else:
        zero = F.lit("00" * rules.parts)
        coded = kept.select("vec_id", "label", zero.alias("code"), F.lit(0).cast("long").alias("error"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    told = attach(coded, totals, ["label"], salt="vec_id")
    return told.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))
