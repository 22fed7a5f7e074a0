"""Whitening of vectors by their covariance, worked out in tiles.

The pairs of dimensions are cut into tiles.  Rows are cut into blocks, a block's
columns into strips; the strips of one block of rows are shuffled together, two
at a time, multiplied, and the products are summed up a tile.  The driver
assembles the matrix, which grows with the square of the dimensions and not with
the rows, and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_common_size, staged, vector_rows


@dataclass(frozen=True)
class WhitenRules:
    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    strip: int = 32
    block: int = 4096
    #: Bytes of tiles that a task sums up before it hands them on.
    held: int = 64 << 20


#: Sums of whole numbers below this are exact in doubles.
_EXACT = 2.0**53


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _whole_numbers(rows: DataFrame, rules: WhitenRules) -> DataFrame:
    """vec_id and x, whole numbers as longs, a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = np.floor(rules.scale * vectors.flatten().to_numpy(zero_copy_only=False))
            if flat.size and np.abs(flat).max() >= 2.0**62:
                raise ValueError("a vector has an entry that doesn't fit a long")
            offsets = pa.array(np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int64) + rules.shift))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), x], ["vec_id", "x"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, x array<long>")


def _column_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if not len(x):
                continue
            n += len(x)
            # The upper and lower halves of the numbers are summed apart, so no sum leaves a long.
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], ["n", "dim", "total"])

    found = rows.select("x").mapInArrow(run, "n long, dim int, total string")
    sums = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by = {r["dim"]: (r["n"], int(r["total"])) for r in sums.collect()}
    return (by[0][0], [by[k][1] for k in range(width)]) if by else (0, [])


def _strips(rows: DataFrame, columns: str, centred, width: int, rules: WhitenRules) -> DataFrame:
    """block, strip, rows, most and cells: the columns of a block of rows in strips of some dimensions.

    ``centred`` gives a batch's matrix.  A block is known by its task and place
    in it; the strips are written once, so both sides of a join read the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            whole = centred(batch)
            for start in range(0, len(whole), rules.block):
                part = whole[start : start + rules.block]
                cuts = [np.ascontiguousarray(part[:, k : k + rules.strip]) for k in range(0, width, rules.strip)]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
                columns = [[f"{task}-{place}"] * len(cuts), range(len(cuts)), [len(part)] * len(cuts), [float(np.abs(c).max()) for c in cuts], [c.tobytes() for c in cuts]]
                place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "strip", "n", "most", "cells"])

    return staged(rows.select(columns).mapInArrow(run, "block string, strip int, n int, most double, cells binary"), "strips")


def products(strips: DataFrame, width: int, rules: WhitenRules, exact: bool) -> np.ndarray:
    """The sum over all rows of the products of each two dimensions.

    ``exact``: cells are whole numbers; a task hands its tiles on before a sum
    could leave what doubles hold exactly, and the tasks' sums are added as decimals.
    """
    n_strips = -(-width // rules.strip)
    sides = [strips.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("strip", "n", "most", "cells")]) for s in "ij"]
    pairs = sides[0].join(sides[1], "block").where("strip_i <= strip_j").select("strip_i", "strip_j", "n_i", "most_i", "most_j", "cells_i", "cells_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], list] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (i, j), (tile, _) in tiles.items():
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                columns = [[i] * len(tile), [j] * len(tile), range(len(tile)), [row.tolist() for row in tile]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "j", "line", "cells"])
            tiles.clear()

        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[f"cells_{s}"]).reshape(r["n_i"], -1) for s in "ij")
                key, bound = (r["strip_i"], r["strip_j"]), r["most_i"] * r["most_j"] * r["n_i"]
                if exact and key in tiles and tiles[key][1] + bound >= _EXACT or len(tiles) * rules.strip**2 * 8 > rules.held:
                    yield from told()
                held = tiles.setdefault(key, [np.zeros((a.shape[1], b.shape[1])), 0.0])
                held[0] += a.T @ b
                held[1] += bound
        yield from told()

    sums = pairs.mapInArrow(run, "i int, j int, line int, cells array<double>")
    # Beyond what decimals hold, which no usual vector comes near, sums are doubles.
    largest = (strips.agg(F.sum(F.col("n") * F.col("most") * F.col("most")).alias("s")).first()["s"] or 0.0) if exact else np.inf
    kind = "decimal(38,0)" if largest < 1e36 else "double"
    cell = lambda k: F.sum(F.get("cells", F.lit(k)).cast(kind)).alias(f"c{k}")
    out = np.zeros((width, width), object if kind != "double" else np.float64)
    lines = sums.groupBy("i", "j", "line").agg(*[cell(k) for k in range(min(rules.strip, width))])
    # As many rows as strips x dimensions.
    for r in lines.collect():
        row = r["i"] * rules.strip + r["line"]
        for k in range(min(rules.strip, width - r["j"] * rules.strip)):
            value = r[f"c{k}"] if kind == "double" else int(r[f"c{k}"])
            column = r["j"] * rules.strip + k
            out[row, column] = out[column, row] = value
    assert n_strips * rules.strip >= width
    return out


@dataclass(frozen=True)
class Whitener:
    """What is learned: n and sums of the whole numbers, eigenvectors (a column each) by falling eigenvalue, their shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, as doubles: first by the whole number next to the mean, exactly, then by the rest."""
        near = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, near.tolist(), strict=True)])
        return (x - near).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN for components without any variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exactly; None where that doesn't fit a long."""
        most = max((abs(self.n * int(v) - s) for column, s in zip(x.T, self.sums, strict=True) for v in (column.min(), column.max())), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 2**63 and self.n * int(np.abs(x).max(initial=0)) < 2**63 else object
        gap = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) if v < 2**63 else None for v in (gap * gap).sum(1).tolist()]


def _learned(rows: DataFrame, width: int, rules: WhitenRules) -> Whitener:
    n, sums = _column_sums(rows, width)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    strips = _strips(rows, "x", lambda batch: (_matrix(batch.column("x"), width) - near).astype(np.float64), width, rules)
    whole = products(strips, width, rules, exact=True)
    # Cells are centred to within half a unit; the rest of the mean is taken off exactly, n * sum(yz) - sum(y) * sum(z) over n * n.
    rest = [s - m * n for s, m in zip(sums, near.tolist(), strict=True)]
    if whole.dtype == object:
        cov = np.array([[(n * whole[a, b] - rest[a] * rest[b]) / (n * n) for b in range(width)] for a in range(width)], np.float64)
    else:
        cov = whole / n - np.outer(rest, rest) / n / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(rules.components, width)]
    largest = max(float(values.max(initial=0)), 0.0)
    kept = np.where(values[order] > largest * width * np.finfo(float).eps, values[order], 0.0)
    return Whitener(n, sums, kept, vectors[:, order], float(np.trace(cov)), rules.scale, rules.shift)


def train_whitener(vectors: DataFrame, rules: WhitenRules = WhitenRules()) -> Whitener | None:
    """The whitener of all of ``vectors`` (vec_id, embedding); None without rows or without dimensions."""
    return _fit(vectors, rules)[1]


def _fit(vectors: DataFrame, rules: WhitenRules) -> tuple[DataFrame, Whitener | None, int]:
    rows = staged(_whole_numbers(most_common_size(vector_rows(vectors), "vector"), rules), "whole-numbers")
    first = rows.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    return rows, _learned(rows, width, rules) if width else None, width


def identity_error(rows: DataFrame, whitener: Whitener, width: int, rules: WhitenRules) -> float:
    """Largest absolute entry of the whitened rows' own covariance less the identity, measured over all rows in tiles.

    Components without variance are left out.
    """
    live = whitener.values > 0
    if not live.any():
        return 0.0
    # A column of ones beside the components gives their sums in the same pass.
    size = int(live.sum()) + 1
    cells = lambda batch: np.column_stack([whitener.whitened(_matrix(batch.column("x"), width))[:, live], np.ones(batch.num_rows)])
    sums = products(_strips(rows, "x", cells, size, rules), size, rules, exact=False) / whitener.n
    mean = sums[-1, :-1]
    return float(np.abs(sums[:-1, :-1] - np.outer(mean, mean) - np.eye(size - 1)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, rules: WhitenRules = WhitenRules()) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``vectors``: vec_id, embedding; other columns are left out.  Rows whose
    vector is null or holds null or non-finite entries go; where lengths differ
    those of the most frequent length (of several the longest) stay.  Repeated
    rows count and come out each, an empty table has an empty result.  A
    component without variance has null for ``whitened`` and a share of zero; a
    deviation that doesn't fit a long is null, an entry that doesn't is an error.
    """
    rows, whitener, width = _fit(vectors, rules)
    if whitener is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, whitener, width, rules)
    share = whitener.values / whitener.trace if whitener.trace > 0 else np.zeros(len(whitener.values))
    size = len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rules.block):
                part = batch.slice(start, rules.block)
                x = _matrix(part.column("x"), width)
                z = whitener.whitened(x).ravel()
                each = np.repeat(np.arange(len(x)), size)
                columns = [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), whitener.n)),
                    pa.array(whitener.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(z, mask=np.isnan(z)),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
