import datetime as dt
import random

from pyspark.sql import functions as F

from docketry.functions.similarity import partial
from docketry.operators import detections

DAY = dt.date(2024, 3, 1)


def tables(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, "http://a.org/x").alias("url"), F.lit("SPK").alias("issuer"), F.lit("7/1").alias("number"), F.lit(DAY).alias("day"), F.lit("new rules").alias("title_key"), F.lit("").alias("text"))
    pubs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("reg_id"), F.lit("http://a.org/x").alias("url"), F.lit("SPK").alias("issuer"), F.lit("7/1").alias("number"), F.lit(DAY).alias("day"), F.lit("new rules").alias("title_key"), F.lit("").alias("text"))
    return rows, pubs


def test_rows_of_a_crowded_key_or_title_are_not_multiplied_by_its_publications(spark, monkeypatch):
    handed, one = [], detections._one

    def counted(found, *more):
        handed.append(found.count())
        return one(found, *more)

    monkeypatch.setattr(detections, "_one", counted)
    rows, pubs = tables(spark, 100)
    assert {(r["doc_id"], r["method"]) for r in detections.match_rows(rows, pubs).collect()} == {(0, "url"), (0, "number")}
    none = rows.withColumn("url", F.lit(None).cast("string")).withColumn("number", F.lit(None).cast("string"))
    assert {(r["doc_id"], r["method"]) for r in detections.match_rows(none, pubs).collect()} == {(0, "title")}
    assert max(handed) <= 100


def test_the_best_title_is_the_best_of_all_pairs(spark):
    rng, words = random.Random(3), ["".join(random.Random(k).choice("abcdef") for _ in range(5)) for k in range(9)]
    draw = lambda k: (k, rng.choice([None, "GIB", "HMB", "SPK"]), DAY + dt.timedelta(rng.randint(0, 30)) if k % 11 else None, " ".join(rng.sample(words, rng.randint(1, 4))) if k % 13 else "")
    rows = spark.createDataFrame([draw(k) for k in range(40)], "row long, issuer string, day date, title_key string")
    pubs = spark.createDataFrame([draw(k) for k in range(90)], "doc_id long, issuer string, day date, title_key string").withColumn("reg_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    want = {tuple(r) for r in detections._one(detections.near_titles(rows, pubs), "title").collect()}
    assert {tuple(r) for r in detections.best_titles(rows, pubs, chunk=7).drop("title_key").collect()} == want and len(want) > 20


def test_references_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    day = lambda: DAY + dt.timedelta(rng.randint(0, 90)) if rng.random() < 0.9 else None
    rows = [(k, rng.choice(["A", "B", None]), rng.choice(["1", "2", "3", None]), day()) for k in range(120)]
    pubs = [(k, rng.choice([None, k % 4]), rng.choice("AB"), rng.choice(["1", "2"]), day()) for k in range(14)]
    want = set()
    for k, issuer, number, at in rows:
        if number is not None:
            met = [p for p in pubs if p[2:4] == (issuer, number)]
            near = [p for p in met if at is None or p[4] is None or abs((p[4] - at).days) <= 7]
            regs = {p[1] for p in near} - {None}
            status = "none" if not met else "conflict" if not near else "ambiguous" if len(regs) > 1 else "matched" if regs else "unverified"
            want.add((k, status, *(regs if len(regs) == 1 else [None])))
    got = detections.reference_match(spark.createDataFrame(rows, "row long, issuer string, number string, day date"), spark.createDataFrame(pubs, "doc_id long, reg_id long, issuer string, number string, day date"))
    assert {tuple(r) for r in got.collect()} == want
    assert {w[1] for w in want} == {"none", "conflict", "ambiguous", "matched", "unverified"}
    assert "doc_id" not in got.columns and "count(distinct" not in got._jdf.queryExecution().toString()


def test_candidates_are_ranked_once_a_key(spark):
    rows, pubs = tables(spark, 30)
    pubs = pubs.withColumn("reg_id", F.col("doc_id") % 8).withColumn("score", F.col("doc_id") % 5)
    pairs = rows.join(pubs.select("issuer", "number", "reg_id", "doc_id", "score"), ["issuer", "number"])
    got = detections.key_candidates(rows, pubs, ["issuer", "number"])
    want = detections.review_candidates(pairs.select("row", "reg_id", "doc_id", "score"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_texts_are_compared_whole(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage, start, other = prose(30), prose(100), prose(200)
    assert len(start) > 400
    rows = spark.createDataFrame([(1, None, DAY, passage), (2, None, DAY, f"{start} {other}"), (3, None, DAY, f"{start} {prose(200)}")], "row long, issuer string, day date, text string")
    # 1 stands behind the first 20,000 letters; 2 and 3 begin alike, but only 2 goes on as the document does.
    bodies = {10: f"{prose(4500)} {passage} {prose(20)}", 11: f"{start} {other} {prose(9)}"}
    assert bodies[10].index(passage) > 20_000
    pubs = spark.createDataFrame([(k, k, None, DAY, t) for k, t in bodies.items()], "doc_id long, reg_id long, issuer string, day date, text string")
    want = {(r["row"], k): s for r in rows.collect() for k, t in bodies.items() if (s := partial(r["text"], t, 65.0)[0]) >= 65}
    got = {(r["row"], r["doc_id"]): r["score"] for r in detections.near_texts(rows, pubs).collect()}
    assert got == want and (got[1, 10], got[2, 11]) == (100.0, 100.0) and got.get((3, 11), 0.0) < 100


def test_sides_that_grow_are_not_broadcast(spark):
    rows, pubs = tables(spark, 50)
    records = spark.range(50).selectExpr("id AS reg_id", "'NEW' AS status", "true AS is_relevant", "id % 2 = 0 AS visible")
    ends = spark.createDataFrame([(3, 4)], "reg_id long, into long")
    matches = detections.match_rows(rows, pubs)
    found = detections.outcomes(matches, records, ends)
    picked = detections.with_selections(matches, matches.where("row % 9 = 0").select("row", "reg_id"))
    for df in (matches, found, picked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan
    assert found.count() == picked.count() == 50
