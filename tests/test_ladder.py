"""The link ladder against a plain walk over the documents, and candidate pairs against all pairs."""

import datetime as dt
import random

import pytest
from conftest import DATA

from docketry.functions.similarity import ratio, token_set
from docketry.operators import candidates, ladder, linking
from docketry.operators.candidates import PairRules
from docketry.operators.ladder import LadderRules

DOC = "doc_id long, source string, item string, parent long"


def walk(docs, keys, pairs, answers, never):
    """doc -> (record, method, review_of), one document after the other."""
    record, owner, members, out, version = {}, {}, {}, {}, {}
    source = {d: s for d, s, _, _ in docs}
    said = {(a, b): same for a, b, same in answers}
    bars = {(a, b) for a, b in never} | {(b, a) for a, b in never}
    likes = {}
    for a, b, score in pairs:
        likes.setdefault(b, []).append((score, a))
    for d, s, item, parent in sorted(docs):
        own = sorted((k for k in keys if k[0] == d), key=lambda k: (k[3], k[1]))
        strong, weak = [k[1] for k in own if k[2]], [k[1] for k in own if not k[2]]
        free = lambda r: all(source[m] != s and (m, d) not in bars for m in members[r])  # noqa: B023, E731
        to = method = review = None
        if parent in record and parent < d:
            to, method = record[parent], "attachment"
        else:
            if item is not None and (s, item) in version:
                to, method = version[s, item], "version"
            elif hit := [k for k in strong if k in owner]:
                to, method = owner[hit[0]], "key"
            elif hit := [k for k in weak if k in owner and free(owner[k])]:
                to, method = owner[hit[0]], "title"
            else:
                open_ = [(score, a) for score, a in likes.get(d, ()) if record[a] == a and free(a)]
                if open_ and max(open_)[0] >= 0.7:
                    score, a = max(open_)
                    if score >= 0.9 or said.get((a, d)):
                        to, method = a, "fuzzy" if score >= 0.9 else "confirmed"
                    elif (a, d) not in said:
                        review = a
            to, method = (to, method) if method else (d, "new")
            for k in strong + weak:
                owner.setdefault(k, to)
            if item is not None:
                version[s, item] = to
        record[d] = to
        members.setdefault(to, []).append(d)
        out[d] = (to, method, review)
    return out


def case(seed, n):
    rng = random.Random(seed)
    docs = [(i, f"s{rng.randrange(4)}", rng.choice([None, None, f"i{rng.randrange(n)}"]), rng.randrange(i) if i and rng.random() < 0.1 else None) for i in range(n)]
    if n > 10:
        docs[5] = (5, "s1", None, 10_000)  # a parent that isn't there
    keys = [(i, f"k{rng.randrange(n)}", True, rng.randrange(2)) for i in range(n) if rng.random() < 0.3]
    keys += [(i, f"t{rng.randrange(max(1, n // 6))}", False, 3) for i in range(n) if rng.random() < 0.7]
    main = {d[0]: d[1] for d in docs if d[3] is None or d[3] not in {x[0] for x in docs}}
    pairs = {}
    for _ in range(3 * n):
        a, b = sorted(rng.sample(range(n), 2))
        if a in main and b in main and main[a] != main[b]:
            pairs[a, b] = rng.choice([0.7, 0.75, 0.8999, 0.9, 0.95, 1.0])
    pairs = [(a, b, s) for (a, b), s in pairs.items()]
    answers = [(a, b, rng.random() < 0.5) for a, b, s in pairs if rng.random() < 0.5]
    never = [tuple(rng.sample(range(n), 2)) for _ in range(n // 4)]
    return docs, list({(d, k): (d, k, s, r) for d, k, s, r in keys}.values()), pairs, answers, never


@pytest.mark.parametrize("seed, n, rows", [(2, 250, 50_000), (3, 40, 0), (4, 80, 60)])
def test_as_if_documents_came_one_by_one(spark, seed, n, rows):
    docs, keys, pairs, answers, never = case(seed, n)
    frame = lambda x, kind: spark.createDataFrame(x, kind)
    got = ladder.link_ladder(frame(docs, DOC), frame(keys, "doc_id long, key string, strong boolean, rank int"), frame(pairs, "a long, b long, score double"), frame(answers, "a long, b long, same boolean"), frame(never, "a long, b long"), LadderRules(group_rows=rows))
    want = walk(docs, keys, pairs, answers, never)
    assert {r["doc_id"]: (r["record"], r["method"], r["review_of"]) for r in got.collect()} == want
    assert {m for _, m, _ in want.values()} == set(ladder.METHODS) or n < 200


def test_a_chain_that_components_would_merge(spark):
    """2 and 3 are each like 1's neighbour, but a record takes one document of a source, and only its first document is compared."""
    docs = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None), (3, "a", None, None), (4, "c", None, None)], DOC)
    none = spark.createDataFrame([], "doc_id long, key string, strong boolean")
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.99), (3, 4, 0.93), (1, 4, 0.91)], "a long, b long, score double")
    got = {r["doc_id"]: r["record"] for r in ladder.link_ladder(docs, none, pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    assert ladder.link_ladder(docs.limit(0), none, pairs.limit(0)).collect() == []


def test_many_copies_settle_in_few_rounds(spark):
    """A title that stands in many documents of few sources: each round settles one document a source."""
    docs = spark.createDataFrame([(i, f"s{i % 3}", None, None) for i in range(60)], DOC)
    keys = spark.createDataFrame([(i, "t", False) for i in range(60)], "doc_id long, key string, strong boolean")
    pairs = spark.createDataFrame([], "a long, b long, score double")
    got = {r["doc_id"]: r["record"] for r in ladder.link_ladder(docs, keys, pairs, rules=LadderRules(group_rows=0)).collect()}
    assert got == {i: 0 if i < 3 else i for i in range(60)}


def brute_pairs(rows, fits):
    out = {}
    for x in rows:
        for y in rows:
            if x["doc_id"] < y["doc_id"] and x["source"] != y["source"] and fits(x, y):
                heads = [(r["text"] or "")[:2000].replace("I", "ı").replace("İ", "i").lower() for r in (x, y)]
                issuer = 1.0 if x["issuer"] and y["issuer"] else 0.5
                title = token_set(x["title_key"] or "", y["title_key"] or "") / 100
                full = 0.6 * title + 0.3 + 0.1 * issuer if all(heads) else 1
                text = ratio(*heads) / 100 if all(heads) and full >= 0.7 else None
                score = 0.6 * title + 0.3 * text + 0.1 * issuer if text is not None else 0.85 * title + 0.15 * issuer if not all(heads) else 0
                if score >= 0.7:
                    out[x["doc_id"], y["doc_id"]] = score
    return out


def close(got, want):
    assert got.keys() == want.keys(), (sorted(want.keys() - got.keys())[:5], sorted(got.keys() - want.keys())[:5])
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("chunk", [256, 17])
def test_candidates_are_those_of_all_pairs(spark, chunk):
    rng, base = random.Random(3), dt.date(2024, 1, 1)
    letters = "abcdefghijklmnoprstuvyzIİı"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40)]
    rows = []
    for n in range(150):
        title = rng.sample(words, rng.randint(0, 6)) if n % 3 or not rows else (rng.choice(rows)["title_key"] or "").split() + rng.sample(words, rng.randint(0, 3))
        if n % 7 == 0:  # like words, none of them the same
            title = [w[:-1] + rng.choice(letters) for w in title]
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) if n % 4 else rng.choice(["", None])
        if n % 5 == 0 and rows:
            text = (rng.choice(rows)["text"] or "").upper()
        rows.append({"doc_id": n, "source": f"s{n % 4}", "issuer": [None, "GIB", "HMB", "SPK", ""][n % 5], "day": None if n % 11 == 0 else base + dt.timedelta(rng.randint(0, 30)), "title_key": " ".join(title) if n % 29 else None, "text": text})
    docs = spark.createDataFrame(rows, "doc_id long, source string, issuer string, day date, title_key string, text string")
    got = {(r["a"], r["b"]): r["score"] for r in candidates.fuzzy_candidates(docs, PairRules(chunk=chunk)).collect()}
    fits = lambda x, y: (not x["issuer"] or not y["issuer"] or x["issuer"] == y["issuer"] or {x["issuer"], y["issuer"]} == {"GIB", "HMB"}) and (x["day"] is None or y["day"] is None or abs((x["day"] - y["day"]).days) <= 7)
    want = brute_pairs(rows, fits)
    close(got, want)
    assert len(want) > 50
    assert candidates.fuzzy_candidates(docs.limit(0)).collect() == []


def test_the_query_finds_what_all_pairs_find(spark):
    from docketry.plans import catalogue

    rows = [r.asDict() for r in catalogue._titled(spark, DATA).collect()]
    got = {(r["a"], r["b"]): r["score"] for r in candidates.fuzzy_candidates(catalogue._titled(spark, DATA)).collect()}
    fits = lambda x, y: x["issuer"] == y["issuer"] and abs((x["day"] - y["day"]).days) <= 7
    close(got, brute_pairs(rows, fits))


def test_the_query_of_the_ladder_is_the_walk(spark):
    from docketry.plans import catalogue

    docs, keys, links = catalogue._linked(spark, DATA)
    pairs = [(r["a"], r["b"], r["score"]) for r in candidates.fuzzy_candidates(docs).collect()]
    answers = [(a, b, (a + b) % 3 == 0) for a, b, s in pairs if s < 0.9 and (a + b) % 3 < 2]
    rows = [(r["doc_id"], r["source"], r["item"], None) for r in docs.collect()]
    never = [(d[0] - 7, d[0]) for d in rows if d[0] % 31 == 7]
    want = walk(rows, [tuple(r) for r in keys.select("doc_id", "key", "strong", "rank").collect()], pairs, answers, never)
    assert {r["doc_id"]: (r["record"], r["method"], r["review_of"]) for r in links.collect()} == want


def test_conflicts_are_noted(spark):
    keys = spark.createDataFrame([(1, "url:a", True), (2, "url:b", True), (3, "url:a", True), (3, "url:b", True), (4, "title:x", False), (1, "title:x", False)], "doc_id long, key string, strong boolean")
    links = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 4)], "doc_id long, record long")
    assert {tuple(r) for r in ladder.key_conflicts(keys, links).collect()} == {(1, "url:b", 2)}


def test_records_merge_and_split(spark):
    links = spark.createDataFrame([(1, 1, "new"), (2, 2, "new"), (3, 2, "key"), (4, 4, "new")], "doc_id long, record long, method string")
    keys = spark.createDataFrame([("k1", 1), ("k2", 2), ("k4", 4)], "key string, record long")
    moves = spark.createDataFrame([(2, 1), (4, 2), (1, 1)], "record long, into long")
    moved, owners = linking.merge_records(links, keys, moves)
    assert {tuple(r) for r in moved.collect()} == {(1, 1, "new"), (2, 1, "manual"), (3, 1, "key"), (4, 1, "manual")}
    assert {tuple(r) for r in owners.collect()} == {("k1", 1), ("k2", 1), ("k4", 1)}

    docs = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", None), (3, "b", "y", None), (4, None, None, 2), (5, "b", "y", None), (6, "c", None, None)], DOC)
    links = spark.createDataFrame([(1, 1, "new"), (2, 1, "key"), (3, 1, "version"), (4, 1, "attachment"), (5, 9, "new"), (6, 1, "fuzzy")], "doc_id long, record long, method string")
    keys = spark.createDataFrame([(1, "k1", 1), (2, "k2", 1), (3, "k3", 1), (6, "k6", 1)], "doc_id long, key string, record long")
    moved, owners = linking.split_documents(docs, links, keys, spark.createDataFrame([(2,), (77,)], "doc_id long"))
    assert {tuple(r) for r in moved.collect()} == {(1, 1, "new"), (2, 2, "manual"), (3, 2, "manual"), (4, 2, "manual"), (5, 9, "new"), (6, 1, "fuzzy")}
    assert {tuple(r) for r in owners.collect()} == {(1, "k1", 1), (2, "k2", 2), (3, "k3", 2), (6, "k6", 1)}


def test_golden_records_take_the_official_day(spark):
    d = dt.date
    docs = spark.createDataFrame([(1, "a", "T", None, None, d(2024, 1, 1), None), (2, "b", "U", "SPK", "Tebliğ", d(2024, 1, 2), d(2024, 1, 5)), (3, "c", "V", "GIB", None, d(2024, 1, 3), None)], "doc_id long, source string, title string, issuer string, kind string, day date, gazette_day date")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "doc_id long, record long")
    got = {r["record"]: tuple(r)[1:] for r in linking.golden_records(docs, links).collect()}
    assert got == {1: (2, "a,b", "T", "SPK", "Tebliğ", d(2024, 1, 5)), 3: (1, "c", "V", "GIB", None, d(2024, 1, 3))}
