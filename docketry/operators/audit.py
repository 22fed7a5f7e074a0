"""A chain of hashed events for each record."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def _body(payload: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("|", payload, F.coalesce(before, F.lit(""))), 256)


_CHAINED = "record {kind}, place long, payload string, prev_hash string, row_hash string"


def append_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Rows (record, place, payload) with prev_hash and row_hash, going on from ``heads`` (record, row_hash: each stored chain's last).

    Each hash covers the one before it, so a record's events are folded in order;
    they pass one by one, sorted within a partition, and only the last hash is
    held, however long a chain is.
    """
    kind = dict(events.dtypes)["record"]
    rows = events.select("record", F.lit(1).alias("step"), F.col("place").cast("long").alias("place"), "payload", F.lit(None).cast("string").alias("head"))
    if heads is not None:
        rows = rows.unionByName(heads.select("record", F.lit(0).alias("step"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("payload"), F.col("row_hash").alias("head")))
    ordered = rows.repartition("record").sortWithinPartitions("record", "step", "place", "payload")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, head, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if not begun or r["record"] != record:
                    record, head, begun = r["record"], None, True
                if not r["step"]:
                    head = r["head"]
                    continue
                body = "|".join(x for x in (r["payload"], head or "") if x is not None)
                made = hashlib.sha256(body.encode()).hexdigest()
                out.append((record, r["place"], r["payload"], head, made))
                head = made
            types = [batch.schema.field("record").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["record", "place", "payload", "prev_hash", "row_hash"])

    return ordered.mapInArrow(fold, _CHAINED.format(kind=kind))


def build_chain(events: DataFrame) -> DataFrame:
    """Chains from their beginning."""
    return append_chain(events)


def heads(chained: DataFrame) -> DataFrame:
    """Each record's last place and hash: where further events go on."""
    return chained.groupBy("record").agg(F.max_by("row_hash", "place").alias("row_hash"), F.max("place").alias("place"))


def verify_chain(chained: DataFrame) -> DataFrame:
    """Rows whose hash is missing, whose link is broken, or whose content was changed; a long chain is verified in parts side by side."""
    rows = running(chained.select("record", "place", "payload", "prev_hash", "row_hash"), ["record"], [F.col("place")], lags={"before": F.col("row_hash")})
    problem = F.when(F.col("row_hash").isNull(), "no hash").when(~F.col("prev_hash").eqNullSafe(F.col("before.value")), "broken chain")
    problem = problem.when(_body(F.col("payload"), F.col("prev_hash")) != F.col("row_hash"), "changed content")
    return rows.select("record", "place", problem.alias("problem")).where("problem is not null")


def once(events: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """The events that aren't there yet, each once."""
    return events.dropDuplicates(key).join(present, key, "left_anti")


def revisions(events: DataFrame) -> DataFrame:
    return events.groupBy("record").agg(F.count_if(F.col("kind").isin("revised", "reopened")).alias("revisions"))
