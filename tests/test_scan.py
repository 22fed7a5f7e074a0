"""Running values over long groups, exact percentiles and stored chains, against plain walks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import audit, changes, monitoring, scan


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(50), rng.choice([None, None, rng.randrange(9)]), rng.random() < 0.3) for i in range(n)]


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_running_values(spark, parts):
    rows = rows_of(300)
    frame = spark.createDataFrame(rows, "id long, g string, t int, v int, hit boolean").repartition(5)
    got = scan.running(frame, ["g"], [F.col("t").desc(), F.col("id")], {"n_hits": F.col("hit")}, {"seen": F.col("v")}, {"before": F.col("v")}, parts=parts)
    want = {}
    for g in {r[1] for r in rows}:
        hits, last, before = 0, None, None
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            hits += r[4]
            last = (n, r[3]) if r[3] is not None else last
            want[r[0]] = (n, hits, last, None if before is None else (before[3],))
            before = r
    assert {r["id"]: (r["_n"], r["n_hits"], r["seen"] and tuple(r["seen"]), r["before"] and tuple(r["before"])) for r in got.collect()} == want
    assert scan.running(frame.limit(0), ["g"], [F.col("t")], {"n_hits": F.col("hit")}).collect() == []


def test_percentiles_are_exact(spark):
    rows = [(r[1], r[2] * 1.5 if r[3] else None) for r in rows_of(400, 2)] + [("z", None), ("y", 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in scan.percentiles(frame, ["g"], "v", shares).collect()}
    for g in {r[0] for r in rows if r[1] is not None}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.percentile(values, [50, 95, 0, 100])), abs=1e-9)
    assert "z" not in got
    one = scan.percentiles(frame, [], "v", {"p95": 0.95}).first()
    assert one["p95"] == pytest.approx(np.percentile([v for _, v in rows if v is not None], 95))


def test_gaps_are_filled_within_some_rows(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 3, None), ("a", 4, None), ("b", 5, None), ("b", 6, 7)]
    got = changes.carry_forward(spark.createDataFrame(rows, "k string, t int, v int"), "k", ["t"], "v", 2)
    assert sorted((r["k"], r["t"], r["v"]) for r in got.collect()) == [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("a", 4, None), ("b", 5, None), ("b", 6, 7)]


def test_streaks(spark):
    jobs = spark.createDataFrame([("a", 1, 1, "success"), ("a", 2, 2, "failed"), ("a", 2, 3, "partial"), ("b", 1, 4, "failed"), ("c", 9, 5, "success")], "source string, started_at int, run_id int, status string")
    assert {tuple(r) for r in monitoring.interrupted_streak(jobs).collect()} == {("a", 2), ("b", 1), ("c", 0)}


def test_chains_go_on_and_are_verified(spark):
    events = [(r, p, f"{r}-{p}") for r in range(4) for p in range(30)]
    frame = spark.createDataFrame(events, "record long, place long, payload string")
    first = audit.append_chain(frame.where("place < 13"))
    both = first.unionByName(audit.append_chain(frame.where("place >= 13"), audit.heads(first)))
    want, head = [], {}
    for r, p, text in events:
        made = hashlib.sha256(f"{text}|{head.get(r) or ''}".encode()).hexdigest()
        want.append((r, p, text, head.get(r), made))
        head[r] = made
    assert sorted(map(tuple, both.collect())) == want
    assert audit.verify_chain(both).collect() == []
    hurt = both.where("NOT (record = 1 AND place = 5)").withColumn("payload", F.when(F.expr("record = 2 AND place = 7"), "x").otherwise(F.col("payload"))).withColumn("row_hash", F.when(F.expr("record = 3 AND place = 29"), None).otherwise(F.col("row_hash")))
    assert {tuple(r) for r in audit.verify_chain(hurt).collect()} == {(1, 6, "broken chain"), (2, 7, "changed content"), (3, 29, "no hash")}
