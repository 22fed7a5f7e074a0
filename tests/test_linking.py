import datetime as dt
import random

from conftest import DATA
from pyspark.sql import functions as F

from docketry.functions.similarity import partial, token_set
from docketry.functions.text import punctuation_fold
from docketry.operators import detections, linking


def test_texts_are_compared_in_lower_case_and_related_issuers_count_whole(spark):
    row = spark.range(1).select(linking.pair_score(F.lit("a b"), F.lit("a b"), F.lit("IŞIK TEXT"), F.lit("ışık text"), F.lit("GIB"), F.lit("HMB")).alias("s")).first()
    assert abs(row["s"] - 1) < 1e-9


def test_rows_are_matched_rung_by_rung(spark):
    d = dt.date(2024, 3, 1)
    kinds = "row long, url string, issuer string, number string, day date, title_key string, text string"
    rows = spark.createDataFrame([(1, "http://a.org/x", None, None, d, "", ""), (2, None, "SPK", "7/1", d, "", ""), (3, None, "SPK", None, d, "new rules of cards", ""), (4, None, None, None, d, "zzz", "A needle of some length, in the body of a text, and long enough to be told apart."), (5, None, None, None, d, "", ""), (6, None, "SPK", None, d, "rules cards", "Other words than that one of some length, and they say quite other things to all"), (7, None, None, None, d + dt.timedelta(17), "zzz", "A needle of some length, in the body of a text, and long enough to be told apart.")], kinds)
    pubs = [(10, 100, "https://www.a.org/x/", None, None, d, "q", ""), (11, None, None, "SPK", "7/1", d, "q", ""), (12, 101, None, "SPK", "7/1", d, "q", ""), (13, 102, None, "SPK", None, d + dt.timedelta(5), "rules of cards new", ""), (14, 103, None, "SPK", None, d + dt.timedelta(9), "new rules of cards", ""), (15, 104, None, "TBB", None, d, "q", "before a needle of some length in the body of a text and long enough to be told apart after"), (16, 105, None, "SPK", None, d, "new rules of cards and fees", "Other words than that one, of some length, and they say quite other things to all."), (17, 106, None, "SPK", None, d + dt.timedelta(2), "q", "see: other words than that one of some length and they say quite other things to all")]
    publications = spark.createDataFrame(pubs, "doc_id long, reg_id long, url string, issuer string, number string, day date, title_key string, text string")
    got = {r["row"]: (r["doc_id"], r["method"]) for r in detections.match_rows(rows, publications).collect()}
    # 6: "rules cards" stands in 13 and 16, and 13 comes first with four words; its text is that of 16, another record.
    assert got == {1: (10, "url"), 2: (12, "number"), 3: (13, "title"), 4: (15, "text"), 5: (None, None), 6: (16, "text"), 7: (None, None)}


def test_imported_rows_and_issuers(spark):
    rows = spark.createDataFrame([(1, "2024-02-03", "U1; U2,U3"), (2, "5 Ağustos 2026", None), (3, "x", "")], "row long, day string, units string")
    got = {r["row"]: (r["day"], r["units"]) for r in detections.normal_rows(rows).collect()}
    assert got == {1: (dt.date(2024, 2, 3), ["U1", "U2", "U3"]), 2: (dt.date(2026, 8, 5), []), 3: (None, [])}
    of = lambda v, t: detections.reference_issuer(F.lit(v), F.lit(t), {"SPK": "Sermaye"}, {"(?i)takas": "TAKASBANK"})
    assert tuple(spark.range(1).select(of(" spk", ""), of("sermaye", ""), of("?", "Takas"), of(None, None)).first()) == ("SPK", "SPK", "TAKASBANK", None)


def test_chains_end_and_circles_end_where_they_close(spark):
    moves = spark.createDataFrame([(n, n + 1) for n in range(50)] + [(100, 101), (101, 102), (102, 101), (103, 100), (200, 200)], "reg_id long, into long")
    got = {r["reg_id"]: r["into"] for r in linking.follow_merges(moves).collect()}
    assert got == {n: 50 for n in range(50)} | {100: 101, 101: 101, 102: 102, 103: 101, 200: 200}


def test_texts_and_titles_are_those_of_all_pairs(spark):
    rng, base = random.Random(1), dt.date(2024, 1, 1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    pubs = [(100 + n, n if n % 3 else None, [None, "GIB", "HMB", "SPK"][n % 4], base + dt.timedelta(rng.randint(0, 40)) if n % 9 else None, " ".join(rng.sample(words, rng.randint(1, 5))), " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for n in range(60)]
    rows = []
    for n in range(25):
        own = rng.choice(pubs)
        w = own[5].split()
        start = rng.randint(0, max(0, len(w) - 20))
        text = [rng.choice(words) if rng.random() < 0.2 else x for x in w[start : start + 20]]
        rows.append((n, [None, None, "GIB", "SPK"][n % 4], (own[3] or base) + dt.timedelta(rng.randint(-3, 15)), own[4][:-1] + "x" if n % 2 else own[4], ", ".join(text).upper()))
    left = spark.createDataFrame(rows, "row long, issuer string, day date, title_key string, text string")
    right = spark.createDataFrame(pubs, "doc_id long, reg_id long, issuer string, day date, title_key string, text string")
    fits = lambda a, b: not a or not b or a == b or {a, b} == {"GIB", "HMB"}
    titles, texts = {}, {}
    for r in rows:
        for p in pubs:
            if p[3] and fits(r[1], p[2]):
                gap = (p[3] - r[2]).days
                if abs(gap) <= 7 and token_set(r[3], p[4]) >= 85:
                    titles[r[0], p[0]] = token_set(r[3], p[4])
                needle = " ".join(r[4].lower().split(", "))[:400]
                if -14 <= gap <= 2 and len(needle) >= 60 and (score := partial(needle, p[5])[0]) >= 65:
                    texts[r[0], p[0]] = score
    for chunk in (512, 7):
        assert {(r["row"], r["doc_id"]): r["score"] for r in detections.near_titles(left, right, chunk=chunk).collect()} == titles
        assert {(r["row"], r["doc_id"]): r["score"] for r in detections.near_texts(left, right, chunk=chunk).collect()} == texts
    assert len(titles) > 5 and len(texts) > 5


def test_the_query_of_texts_finds_what_all_pairs_find(spark):
    from docketry.plans import portal

    rows, pubs = (x.withColumn("t", punctuation_fold("text")).collect() for x in portal._passages(spark, DATA))
    want = {}
    for r in rows:
        for p in pubs:
            if r["t"] and p["t"] and len(r["t"][:400]) >= 60 and -14 <= (p["day"] - r["day"]).days <= 2:
                score = partial(r["t"][:400], p["t"][:20000], 65.0)[0]
                if score >= 65:
                    want[r["row"], p["doc_id"]] = round(score, 2)
    assert {(r["row"], r["doc_id"]): r["score"] for r in portal.text_pairs(spark, DATA).collect()} == want
    found = {r["row"]: r["doc_id"] for r in portal.passage_matches(spark, DATA).collect()}
    assert {k for k, v in found.items() if v is not None} == {k for k, _ in want}
