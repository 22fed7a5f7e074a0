"""Comparing rows of two tables that lie near each other in time, tile by tile.

For likenesses that no index finds whole.  Rows are dealt into chunks of equal
size within windows of days, so a crowded window is many chunks and no task gets
more than one chunk of either side at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import shuffled, staged


def window_of(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)


def _chunk_id(side: str, w: Column, k: Column) -> Column:
    return F.concat_ws("/", F.lit(side), F.coalesce(w.cast("string"), F.lit("any")), k.cast("string"))


class Side:
    """Rows (w, key, r) in chunks: ``w`` the window (null: may belong to any), ``key`` what rows are dealt by, ``r`` a struct of what is compared."""

    def __init__(self, rows: DataFrame, name: str, size: int):
        rows = staged(rows.select("w", "key", "r"), f"{name}-rows")
        # A row a window: how many chunks it has.
        self.sizes = staged(rows.groupBy("w").agg(F.ceil(F.count("*") / size).cast("int").alias("chunks")), f"{name}-windows")
        same = F.col("rows.w").eqNullSafe(F.col("sizes.w"))
        dealt = rows.alias("rows").join(self.sizes.alias("sizes"), same).select("rows.w", F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("k"), "r")
        grouped = dealt.groupBy(_chunk_id(name, F.col("w"), F.col("k")).alias("chunk"))
        self.chunks, self.name = staged(grouped.agg(F.collect_list("r").alias("rows")), f"{name}-chunks"), name

    def each(self) -> DataFrame:
        return self.sizes.select("w", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))


def _tiles(left: Side, right: Side, reach: range) -> DataFrame:
    """left and right: chunks of windows within ``reach`` of each other, and of the undated and any; within one table each two once."""
    one = left is right
    a, b = left.each().alias("a"), right.each().alias("b")
    k_a, k_b, w_a, w_b = (F.col(c) for c in ("a.k", "b.k", "a.w", "b.w"))
    # Rows of chunks, not of what is compared: a window has few.
    met = left.each().withColumn("target", F.explode(F.array(*[F.col("w") + n for n in reach]))).alias("a").join(b, F.col("a.target") == w_b)
    found = [met.where((w_a < w_b) | (k_a <= k_b)) if one else met]
    every = lambda side, where: side.where(where).withColumn("any", F.lit(1))
    found.append(every(a, "w is null").join(every(b, "w is not null"), "any"))
    undated = every(a, "w is null").join(every(b, "w is null"), "any")
    found.append(undated.where(k_a <= k_b) if one else undated)
    if not one:
        found.append(every(a, "w is not null").join(every(b, "w is null"), "any"))
    named = [x.select(_chunk_id(left.name, w_a, k_a).alias("left"), _chunk_id(right.name, w_b, k_b).alias("right")) for x in found]
    out = named[0]
    for x in named[1:]:
        out = out.union(x)
    return staged(out, "tiles")


def compare(left: Side, right: Side, reach: range, one_tile: Callable[[list, list, bool], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``one_tile`` (rows, rows, whether both are one chunk) gives for all tiles.

    ``reach``: how many windows after a left row's own a right row's may be; for
    one table on both sides from 0 on.
    """
    tiles, spark = _tiles(left, right, reach), left.chunks.sparkSession
    n = tiles.count()
    if not n:
        return spark.createDataFrame([], schema)
    sides = [shuffled(s.chunks.select(F.col("chunk").alias(c), F.col("rows").alias(f"{c}_rows"))) for s, c in ((left, "left"), (right, "right"))]
    tasks = min(n, 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    # Dealt out by number, so that adaptive plans don't put dear tiles into few tasks.
    loaded = tiles.join(sides[0], "left").join(sides[1], "right").repartition(tasks, "left", "right")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                yield pd.DataFrame(one_tile(t.left_rows, t.right_rows, t.left == t.right), columns=names)

    return loaded.select("left", "right", "left_rows", "right_rows").mapInPandas(run, schema)
