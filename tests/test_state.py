"""Streams with state, batch by batch, against plain walks over all rows."""

import datetime as dt
import random
from datetime import timedelta

from conftest import DATA
from pyspark.sql import functions as F

from docketry.plans import catalogue
from docketry.streaming import ingest, state

T = dt.datetime(2024, 5, 1)


def stream_of(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return ingest.source(spark, f"{tmp_path}/in", schema, 1)


def test_children_wait_go_on_and_are_given_up(spark, tmp_path):
    h = lambda n: T + timedelta(hours=n)
    batches = [
        [(1, None, h(0)), (11, 1, h(0)), (21, 2, h(0)), (31, 3, h(0))],
        [(22, 2, h(1)), (12, 1, h(1)), (2, None, h(2)), (41, 4, h(3))],
        [(9, None, h(30))],  # time passes, and 3 and 4 haven't come
        [(3, None, h(30)), (32, 3, h(31)), (23, 2, h(31)), (10, None, h(32))],
    ]
    stream = state.with_parents(stream_of(spark, tmp_path, batches, "id long, parent long, at timestamp"), timedelta(hours=10), "1 hour")
    got = [(r["id"], r["parent"], r["state"]) for r in state.replayed(stream, spark, "t").collect()]
    ready = {(1, None), (11, 1), (12, 1), (2, None), (21, 2), (22, 2), (23, 2), (3, None), (32, 3), (9, None), (10, None)}
    assert set(got) == {(*x, "ready") for x in ready} | {(31, 3, "orphan"), (41, 4, "orphan")} and len(got) == 13
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_parent_that_comes_again_counts_by_each_of_its_rows(spark, tmp_path):
    h = lambda n: T + timedelta(hours=n)
    batches = [
        [(21, 2, h(0)), (2, None, h(12)), (31, 3, h(0))],
        [(2, None, h(8)), (2, None, h(8)), (22, 2, h(9)), (22, 2, h(9)), (3, None, h(11))],
        [(9, None, h(99))],
    ]
    stream = state.with_parents(stream_of(spark, tmp_path, batches, "id long, parent long, at timestamp"), timedelta(hours=10), "24 hours")
    got = sorted((r["id"], r["state"]) for r in state.replayed(stream, spark, "t").collect())
    assert got == [(2, "ready")] * 3 + [(3, "ready"), (9, "ready"), (21, "ready"), (22, "ready"), (22, "ready"), (31, "orphan")]
    assert stream._jdf.queryExecution().logical().toString().count("TransformWithState") == 0


def life(rows, quiet, snooze, until):
    """By the definition, key by key in order of time."""
    out = []
    for key in {r[0] for r in rows}:
        opened = closed = None
        last, acked, slept, most = None, False, False, 0
        own = sorted((r for r in rows if r[0] == key and r[1] <= until), key=lambda r: (r[1], r[2] != "found", r[3]))
        for _, at, kind, severity in [*own, (key, until, "end", 0)]:
            if opened and at > last + quiet:
                closed, slept, opened = last + quiet, acked, None
                out.append((key, closed, "resolved", most))
            if kind == "ack":
                acked = acked or bool(opened)
            elif kind == "found" and opened:
                last, most = at, max(most, severity)
            elif kind == "found" and slept and at < closed + snooze:
                out.append((key, at, "snoozed", severity))
            elif kind == "found":
                opened = last = at
                acked, slept, most = False, False, severity
                out.append((key, at, "opened", severity))
    return sorted(out)


def test_alerts_open_close_and_sleep(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(5)}", T + timedelta(minutes=rng.randrange(6000)), rng.choice(["found", "found", "ack"]), rng.randrange(4)) for _ in range(400)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(100)))  # out of order by less than the watermark
    batches = [rows[k : k + 100] for k in range(0, 400, 100)]
    stream = state.alert_lifecycle(stream_of(spark, tmp_path, batches, "key string, at timestamp, kind string, severity int"), timedelta(minutes=45), timedelta(hours=6), "2 hours")
    got = sorted((r["key"], r["at"], r["action"], r["severity"]) for r in state.replayed(stream, spark, "t").collect())
    until = max(r[1] for r in rows) - timedelta(hours=2)
    assert got == life(rows, timedelta(minutes=45), timedelta(hours=6), until)
    assert {a for _, _, a, _ in got} == {"opened", "resolved", "snoozed"}


def test_the_query_of_alerts_is_the_walk(spark):
    rows = [(r["key"], r["at"], r["kind"], r["severity"]) for r in catalogue._observations(spark, DATA).collect()]
    got = sorted((r["key"], r["at"], r["action"], r["severity"]) for r in catalogue.stream_alerts(spark, DATA).collect())
    assert got == life(rows, timedelta(hours=2), timedelta(hours=24), max(r[1] for r in rows) - timedelta(days=60))


def test_the_query_of_children_holds_back_orphans(spark):
    rows = catalogue._families(spark, DATA)
    got = {r["id"] for r in catalogue.stream_late_children(spark, DATA).collect()}
    assert got == {r["id"] for r in rows.where("parent is null or parent >= 0").collect()}
    assert rows.where(F.col("parent") < 0).count()
