"""Streams that remember: children that wait for their parents, and alerts that open, close and sleep.

State lives in the state store under the stream's key, so it moves with its
partition when an executor is lost and grows on disk, not in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.session import shared_path

#: State on disk, and of the watermarks of several inputs, which are parts of one stream, the latest.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.multipleWatermarkPolicy": "max",
}


def replayed(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All that a stream appends while it works off what is there, from the shared folder; a batch that is run again replaces itself."""
    path = shared_path(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    # A query takes its settings along when it starts.
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(path).drop("batch") if query.lastProgress else spark.createDataFrame([], stream.schema)


def _ms(at: pd.Timestamp) -> int:
    return round(at.timestamp() * 1000)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def with_parents(stream: DataFrame, wait: timedelta, late: str = "1 hour") -> DataFrame:
    """id, parent, state of the rows (id, parent, at) of a stream: ``ready`` as soon as the parent is there, ``orphan`` if it didn't come in time.

    A row without parent is ready at once and lets its children go, those that
    wait and those that come later.  In time is a parent whose own time is at most
    ``wait`` after the child's, however the batches fall; children are given up
    when the watermark, which is ``late`` behind, has passed that.

    Spark joins the stream with itself: the semi join tells a child once however
    many rows its parent has, the outer one tells those that nothing met.  Each side
    has its own watermark, so a query that isn't started by :func:`replayed` waits
    for the slower one unless ``spark.sql.streaming.multipleWatermarkPolicy`` is max.
    """
    rows = stream.select("id", "parent", "at").withWatermark("at", late)
    own, children = rows.where("parent is null"), rows.where("parent is not null")
    parents = own.select(F.col("id").alias("family"), F.col("at").alias("since"))
    in_time = F.col("since") <= F.col("at") + F.expr(f"interval {wait // timedelta(milliseconds=1)} milliseconds")
    met = (F.col("parent") == F.col("family")) & in_time
    told = lambda df, state: df.select("id", "parent", F.lit(state).alias("state"))
    ready = children.join(parents, met, "left_semi")
    orphans = children.join(parents, met, "left").where("family is null")
    return told(own, "ready").unionByName(told(ready, "ready")).unionByName(told(orphans, "orphan"))


class _Alert(StatefulProcessor):
    """One key's alert.  What is seen is kept until the watermark has passed it, so it counts in order of its time, however it comes."""

    def __init__(self, quiet_ms: int, snooze_ms: int):
        self.quiet, self.snooze = quiet_ms, snooze_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long, found boolean, severity int")
        # When it opened and was last found (0: not open), its severity, whether somebody acknowledged it, when it closed, and whether acknowledged.
        self.now = handle.getValueState("now", "opened long, last long, severity int, acked boolean, closed long, slept boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(_ms(r["at"]), r["kind"] == "found", int(r["severity"])) for part in rows for r in part.to_dict("records")]
        self.seen.appendList(new)
        for at in {x[0] for x in new}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.seen.get()) if self.seen.exists() else []
        # Of one moment what was found counts before what was acknowledged.
        due = sorted((x for x in held if x[0] <= until), key=lambda x: (x[0], not x[1], x[2]))
        opened, last, severity, acked, closed, slept = self.now.get() if self.now.exists() else (0, 0, 0, False, 0, False)
        out: list[tuple] = []

        def quiet_by(at: int) -> None:
            nonlocal opened, closed, slept
            if opened and at > last + self.quiet:
                out.append((_at(last + self.quiet), "resolved", severity))
                opened, closed, slept = 0, last + self.quiet, acked

        for at, found, how in due:
            quiet_by(at)
            if not found:
                acked = acked or bool(opened)
            elif opened:
                last, severity = at, max(severity, how)
            elif slept and at < closed + self.snooze:
                out.append((_at(at), "snoozed", how))
            else:
                opened, last, severity, acked, slept = at, at, how, False, False
                out.append((_at(at), "opened", how))
        quiet_by(until)
        self.now.update((opened, last, severity, acked, closed, slept))
        if due:
            left = [x for x in held if x[0] > until]
            self.seen.put(left) if left else self.seen.clear()
        if opened and last + self.quiet + 1 > until:
            self.handle.registerTimer(last + self.quiet + 1)
        yield pd.DataFrame([(*key, *x) for x in out], columns=["key", "at", "action", "severity"]).astype({"key": object, "at": "datetime64[us]", "action": object, "severity": "int32"})

    def close(self) -> None:
        pass


def alert_lifecycle(stream: DataFrame, quiet: timedelta = timedelta(hours=1), snooze: timedelta = timedelta(hours=24), late: str = "1 hour") -> DataFrame:
    """key, at, action, severity: when alerts open, are resolved, or stay shut though found again.

    ``stream``: key, at, kind (``found`` or ``ack``), severity.  A found key
    opens an alert unless one is open; an open one that isn't found again for
    longer than ``quiet`` is resolved at the end of that time, by a timer where
    nothing more comes.  One that was acknowledged while it was open sleeps for
    ``snooze`` after it is resolved: what is found by then is ``snoozed``.  All is
    told once the watermark, ``late`` behind, has passed it.
    """
    unit = timedelta(milliseconds=1)
    keyed = stream.select("key", "at", "kind", F.coalesce("severity", F.lit(0)).cast("int").alias("severity")).withWatermark("at", late)
    return keyed.groupBy("key").transformWithStateInPandas(_Alert(quiet // unit, snooze // unit), "key string, at timestamp, action string, severity int", "append", "eventTime")
