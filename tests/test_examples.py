import random

from conftest import DATA

from docketry.functions.similarity import TokenSet, token_set
from docketry.operators import examples, inbox
from docketry.operators.inbox import ListQuery
from docketry.plans import bindings, catalogue


def brute(texts, known, k):
    out = []
    for record, text in texts:
        every = sorted((-token_set(text or "", t or "") * w, e) for e, t, w in known)[:k]
        out += [(record, place, e, round(-s, 4)) for place, (s, e) in enumerate(every, 1)]
    return sorted(out)


def test_the_nearest_are_those_of_all(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    title = lambda: " ".join(rng.sample(words, rng.randint(0, 6)))
    texts = [(n, title() if n % 9 else None) for n in range(60)]
    known = [(n, title(), rng.choice([0.0, 1.0, 2.0])) for n in range(80)] + [(500, None, 1.0)]
    left, right = spark.createDataFrame(texts, "record long, text string"), spark.createDataFrame(known, "example long, text string, weight double")
    for chunk in (512, 11):
        assert sorted(map(tuple, examples.nearest(left, right, 4, chunk).collect())) == brute(texts, known, 4)
    assert examples.nearest(left, right.limit(0), 4).collect() == []


def test_one_text_against_many_is_the_token_set_ratio():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcç") for _ in range(rng.randint(1, 5))) for _ in range(14)]
    for _ in range(4000):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert TokenSet(a).ratio(b, set(b.split())) == token_set(a, b), (a, b)


def test_copies_are_compared_once(spark, monkeypatch):
    rng, sizes, real = random.Random(8), {}, examples.tiles.Side
    names = ["rules of cards", "Rules of Cards", "new rules", "fees of banks", "", "cards of rules and fees"]
    texts = [(n, rng.choice(names)) for n in range(300)]
    known = [(n, rng.choice(names), rng.choice([1.0, 2.0])) for n in range(200)]

    def counted(rows, name, size):
        sizes[name] = rows.count()
        return real(rows, name, size)

    monkeypatch.setattr(examples.tiles, "Side", counted)
    left, right = spark.createDataFrame(texts, "record long, text string"), spark.createDataFrame(known, "example long, text string, weight double")
    want = brute([(n, t.lower()) for n, t in texts], [(n, t.lower(), w) for n, t, w in known], 3)
    assert sorted(map(tuple, examples.nearest(left, right, 3, 2, 4).collect())) == want
    assert sizes["texts"] <= 5 and sizes["examples"] <= 5 * 2 * 3


def test_the_query_is_all_pairs(spark):
    texts, known = ([tuple(r) for r in x.collect()] for x in catalogue._examples(spark, DATA))
    assert sorted(map(tuple, catalogue.nearest_examples(spark, DATA).collect())) == brute(texts, known, 5)


def test_criteria_that_need_a_table_say_so(spark):
    import pytest

    records, units = bindings.records(spark, DATA), bindings.suggestions(spark, DATA)
    for q in (ListQuery("2001-08-01", sources=("s1",)), ListQuery("2001-08-01", edited=True), ListQuery("2001-08-01", detected=("soon",))):
        with pytest.raises(ValueError):
            inbox.filtered(records, units, q)
    assert inbox.filtered(records, units, ListQuery("2001-08-01", ids=())).collect() == []


def test_a_tile_is_loaded_with_several_blocks(spark, monkeypatch):
    rng, loaded, real = random.Random(4), {}, examples.tiles.Side
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts, known = [(n, f"{word()} {word()}") for n in range(40)], [(n, f"{word()} {word()}", 1.0) for n in range(30)]

    def noted(rows, name, size):
        side = real(rows, name, size)
        loaded[name] = side.chunks.count()
        return side

    monkeypatch.setattr(examples.tiles, "Side", noted)
    left, right = spark.createDataFrame(texts, "record long, text string"), spark.createDataFrame(known, "example long, text string, weight double")
    assert sorted(map(tuple, examples.nearest(left, right, 3, 4, 5).collect())) == brute(texts, known, 3)
    # 10 blocks of texts and 6 of examples, but fewer tiles, as each is sent once a tile.
    assert loaded["texts"] <= 3 and loaded["examples"] <= 3
