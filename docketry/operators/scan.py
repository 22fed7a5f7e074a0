"""Running values over few, long groups: a dozen sources with all their history shouldn't make a dozen tasks.

Rows are sorted by range over group and order, so a long group lies in several
partitions one after the other.  Each partition works out its own running
values, hands on one row for each group it ends in, and what a partition has to
add to the group that it begins with is at most one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import staged


def running(rows: DataFrame, by: list[str], order: list[Column], counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with running values within ``by``, in ``order`` (columns with a direction; ties in any order).

    ``counts``: how often a condition held up to and with the row; ``lasts``: the
    last value up to and with the row that isn't null, as a struct (at, value) with
    its row's number from 1; ``lags``: the value of the row before, as a struct
    (value), null for a group's first row.  ``_n`` is the row's own number.
    ``parts``: partitions, by default as many as the data's size asks for.
    """
    counts, lasts, lags = counts or {}, lasts or {}, lags or {}
    values = {f"_c_{k}": F.coalesce(v.cast("boolean"), F.lit(False)).cast("long") for k, v in counts.items()}
    values |= {f"_l_{k}": v for k, v in lasts.items()} | {f"_g_{k}": v for k, v in lags.items()}
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    spread = rows.withColumn("_group", group).repartitionByRange(*([parts] if parts else []), F.col("_group"), *order).sortWithinPartitions("_group", *order)
    spread = spread.withColumns(values).withColumn("_part", F.spark_partition_id()).withColumn("_turn", F.monotonically_increasing_id())
    spread = staged(spread, "ranges")
    local = Window.partitionBy("_part", "_group").orderBy("_turn")
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    one = spread.withColumn("_own", F.row_number().over(local).cast("long"))
    whole = one.groupBy("_group", "_part").agg(
        F.count("*").alias("_size"),
        *[F.sum(f"_c_{k}").alias(f"_c_{k}") for k in counts],
        *[F.max(F.when(F.col(f"_l_{k}").isNotNull(), F.struct(F.col("_own").alias("at"), F.col(f"_l_{k}").alias("value")))).alias(f"_l_{k}") for k in lasts],
        *[F.max_by(F.struct(F.col(f"_g_{k}").alias("value")), "_own").alias(f"_g_{k}") for k in lags],
    )
    # A row for each group in a partition; of one group there are as many as partitions.
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.sum("_size").over(before)
    moved = {k: F.when(F.col(f"_l_{k}").isNotNull(), F.struct((F.col(f"_l_{k}.at") + F.coalesce("_offset", F.lit(0))).alias("at"), F.col(f"_l_{k}.value").alias("value"))) for k in lasts}
    carried = whole.withColumn("_offset", offset).withColumns({f"_m_{k}": c for k, c in moved.items()}).select(
        F.col("_group").alias("_of"),
        F.col("_part").alias("_at"),
        "_offset",
        *[F.sum(f"_c_{k}").over(before).alias(f"_bc_{k}") for k in counts],
        *[F.last(f"_m_{k}", ignorenulls=True).over(before).alias(f"_bl_{k}") for k in lasts],
        *[F.last(f"_g_{k}").over(before).alias(f"_bg_{k}") for k in lags],
    )
    # Only a partition's first group goes on from the one before: a row a partition at most.
    carried = carried.where("_offset is not null")
    both = one.join(F.broadcast(carried), (F.col("_group") == F.col("_of")) & (F.col("_part") == F.col("_at")), "left")
    number = F.col("_own") + F.coalesce("_offset", F.lit(0))
    out = {"_n": number}
    for k in counts:
        out[k] = F.sum(f"_c_{k}").over(so_far) + F.coalesce(f"_bc_{k}", F.lit(0))
    for k in lasts:
        own = F.last(F.when(F.col(f"_l_{k}").isNotNull(), F.struct(number.alias("at"), F.col(f"_l_{k}").alias("value"))), ignorenulls=True).over(so_far)
        out[k] = F.coalesce(own, f"_bl_{k}")
    for k in lags:
        out[k] = F.coalesce(F.lag(F.struct(F.col(f"_g_{k}").alias("value"))).over(local), f"_bg_{k}")
    return both.withColumns(out).select(*rows.columns, *out)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and for each name the exact percentile of the values that aren't null, between two rows in proportion.

    By rank in a sort over all partitions: no group's values are gathered.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ranked = running(kept, by, [F.col("_v")])
    ranked = staged(ranked, "ranks")
    group = [F.col(c) for c in by]
    sizes = ranked.groupBy(*group).agg(F.max("_n").alias("_size")).withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), by, F.lit(True))
    low = lambda p: F.floor((F.col("_size") - 1) * p)
    # A row a group, and of each group two rows a share are left.
    near = ranked.join(F.broadcast(sizes), same).select(*by, "_v", "_n", "_size")
    near = near.where(reduce(lambda a, p: a | (F.col("_n") - 1).between(low(p), low(p) + 1), shares.values(), F.lit(False)))

    def share(p: float) -> Column:
        rest = (F.col("_size") - 1) * p - low(p)
        at = lambda k: F.max(F.when(F.col("_n") - 1 == low(p) + k, F.col("_v")))
        part = F.max(rest)
        return at(0) + F.when(part > 0, (at(1) - at(0)) * part).otherwise(0.0)

    return near.groupBy(*by).agg(*[share(p).alias(name) for name, p in shares.items()])
