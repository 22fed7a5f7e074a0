"""Quotes in texts and tables of texts, against plain searches."""

import random
import re

import pytest
from conftest import DATA

from docketry.functions import grounding
from docketry.functions.similarity import Sieve, common, partial
from docketry.operators import detections


def plain_partial(a, b):
    """Every window, by its definition."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for start in range(1 - len(short), len(long)):
        part = long[max(start, 0) : start + len(short)]
        best = max(best, 200.0 * common(short, part) / (len(short) + len(part)))
    return best


@pytest.mark.parametrize("least", [0.0, 65.0, 90.0])
def test_the_best_part_is_that_of_all_windows(least):
    rng = random.Random(int(least))
    for _ in range(250):
        a = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40)))
        b = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.7:  # a changed copy inside
            copy = [c for c in a if rng.random() > 0.06]
            for _ in range(rng.randint(0, 3)):
                copy.insert(rng.randint(0, len(copy)), rng.choice("abcdef"))
            b = b[: len(b) // 2] + "".join(copy) + b[len(b) // 2 :]
        score, low, high = partial(a, b, least)
        want = plain_partial(a, b)
        assert score == (want if want >= least else 0.0), (a, b)
        if score and len(a) <= len(b):
            assert 200.0 * common(a, b[low:high]) / (len(a) + high - low) == score


def best_of(quote, sources):
    """By the ladder's definition, part for part over all sources, ids rising."""
    parts = [p.strip(" .,;:\"'") for p in re.split(r"\.\.\.|…|\[\.\.\.\.\]", quote or "")]
    parts = [p for p in parts if p]
    if sum(map(len, parts)) < 12:
        return None
    found = []
    for p in parts:
        p = grounding.folded(p)[0]
        if len(p) < 6:
            return None
        hits = []
        for doc, source in sources:
            if hit := source.exactly(p):
                hits.append((0, 0.0, doc, hit))
        if not hits:
            for doc, source in sources:
                if hit := source.nearly(p, 90.0):
                    hits.append((1, -hit.score, doc, hit))
        if not hits:
            for doc, source in sources:
                if hit := source.with_gaps(p):
                    hits.append((2, 0.0, doc, hit))
        if not hits:
            return None
        found.append(min(hits, key=lambda h: h[:3])[2:])
    docs = {d for d, _ in found}
    return found[0][0], found[0][1].start, (found[-1][1] if len(docs) == 1 else found[0][1]).stop, round(min(h.score for _, h in found), 1), grounding.METHODS[max(h.rung for _, h in found)]


def test_the_query_over_all_documents(spark):
    from docketry.plans import catalogue

    got = {r["item_id"]: tuple(r)[1:] for r in catalogue.quote_ladder(spark, DATA).collect()}
    words = catalogue.F.filter(catalogue.F.split("text", r"\s+"), lambda w: w != "")
    quotes = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", catalogue._altered(words, catalogue.F.col("item_id")).alias("quote")).collect()
    sources = [(r["doc_id"], grounding.Source(r["text"])) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    want = {q["item_id"]: best_of(q["quote"], sources) for q in quotes}
    assert got == {k: v for k, v in want.items() if v}
    assert got


def test_the_query_over_the_sources_of_a_record(spark):
    from docketry.plans import catalogue

    got = {r["item_id"]: tuple(r)[1:] for r in catalogue.claim_evidence(spark, DATA).collect()}
    claims, sources = catalogue._claims(spark, DATA)
    by: dict[int, list] = {}
    for r in sources.orderBy("doc_id").collect():
        by.setdefault(r["record"], []).append((r["doc_id"], grounding.Source(r["text"] or "")))
    want = {c["item_id"]: best_of(c["quote"], by[c["record"]]) for c in claims.collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert {v[4] for v in got.values()} >= {"exact", "exact_words", "elided"} and len(got) > 100


def test_rungs_and_sources(spark):
    texts = {1: "Giriş. Bankalar, sermaye yeterliliği oranını  her ay sonunda Kuruma bildirir.\nSon hüküm budur.", 2: "Başka bir metin; sermaye yeterliliği oranını her ay.", 3: None, 4: ""}
    quotes = {
        1: "sermaye yeterliliği oranını her ay",
        2: "Bankalar sermaye yeterliliği oranını her ay",
        3: "sermaye yeterliligi oranını her ay sonunda",
        4: "Bankalar oranını sonunda Kuruma bildirir",
        5: "Başka bir metin … Son hüküm budur",
        6: "tamamen başka bir cümle burada",
        7: "kısa",
        8: None,
        9: "Başka bir metin ... ab",
    }
    docs = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, score int")
    items = spark.createDataFrame([(k, q, 1) for k, q in quotes.items()], "item_id long, quote string, record long")
    want = {1: (1, "exact"), 2: (1, "exact_words"), 3: (1, "fuzzy"), 4: (1, "elided"), 5: (2, "exact")}
    for found in (grounding.find_quotes(items, docs), grounding.quote_evidence(items, docs.selectExpr("1L AS record", "*"))):
        assert {r["item_id"]: (r["doc_id"], r["method"]) for r in found.collect()} == want
    assert grounding.find_quotes(items.limit(0), docs).collect() == []
    assert grounding.find_quotes(items, docs.limit(0)).collect() == []


def test_blocks_of_quotes_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    quotes = spark.read.parquet(f"{DATA}/benchmark.parquet").selectExpr("item_id", "text AS quote", "text")
    one = sorted(map(tuple, grounding.exact_quotes(quotes, docs).collect()))
    monkeypatch.setattr(grounding, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, grounding.exact_quotes(quotes, docs).collect())) == one


def test_folding_by_whole_texts_is_folding_by_letters():
    rng = random.Random(8)
    letters = ["I", "İ", "Σ", "a", "ß", "\xad", " ", "\n", "\x1c", " ", "\xa0", "\f", "’", "—", "Â", "ẞ", "😀", "\0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(4000)] + [chr(c) for c in range(0x3000)]
    for t in texts:
        assert grounding.folded(t) == grounding._folded_by_letters(t)
        assert grounding.plain_of(t) == grounding._folded_by_letters(t)[0]


def test_a_record_of_very_many_quotes_is_asked_in_blocks(spark):
    n = 2 * grounding.PARTS + 5
    quotes = [(i, 1, f"the words number {i} of all these") for i in range(n)] + [(n, 1, "nothing that any of them holds"), (n + 1, 2, "the words number 7 of all these")]
    text = " . ".join(f"The words number {i} of all these" for i in range(n))
    sources = [(1, 20, text), (1, 10, "the words number 7 of all thesé"), (1, 30, None), (2, 40, "")]
    got = grounding.quote_evidence(spark.createDataFrame(quotes, "item_id long, record long, quote string"), spark.createDataFrame(sources, "record long, doc_id long, text string")).collect()
    # One source has all of them exactly, which counts more than a like one before it.
    assert {(r["item_id"], r["doc_id"], r["score"], r["method"]) for r in got} == {(i, 20, 100.0, "exact") for i in range(n)}


def test_a_sieve_keeps_all_that_is_nearly_there_and_drops_much_else():
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    dropped = 0
    for _ in range(60):
        long, parts = some(rng.randint(0, 400)), [some(rng.randint(1, 90)) for _ in range(6)]
        for _ in range(10):  # changed copies of stretches
            low = rng.randrange(len(long) + 1)
            copy = [c for c in long[low : low + rng.randint(6, 90)] if rng.random() > 0.05]
            for _ in range(len(copy) // 25):
                copy.insert(rng.randrange(len(copy)), "x")
            parts.append("".join(copy) or "a")
        fit = Sieve(parts, 90.0).fit(long)
        source = grounding.Source(long)
        assert all(k for p, k in zip(parts, fit, strict=True) if source.nearly(p, 90.0))
        dropped += (~fit).sum()
    assert dropped > 100 and Sieve([], 90.0).fit("abcde").size == 0


def test_texts_of_the_same_words_are_left_out_by_long_stretches(monkeypatch):
    from docketry.functions import similarity

    rng, read, real = random.Random(6), [], similarity.Subsequence.common
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    some = lambda: " ".join(rng.sample(words, 40))
    part, text = some(), " ".join(some() for _ in range(8))
    monkeypatch.setattr(similarity.Subsequence, "common", lambda self, other: read.append(len(other)) or real(self, other))
    assert partial(part, text, 80.0)[0] == 0.0
    assert partial(part, text, 90.0)[0] == 0.0
    # Stretches of one and a half of the part, twice a part's length, at most three letters for each of the text.
    assert sum(read) < 2 * 4 * len(text)
