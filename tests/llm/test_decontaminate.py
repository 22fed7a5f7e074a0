import random

import pyarrow.parquet as pq
from conftest import DATA

from docketry.llm.decontaminate import Index, Leaks, edit_distance, find_leaks, plain_words
from docketry.llm.queries import op1_decontaminate


def brute(docs, items, rate=0.25):
    """The distance of every item to every document, in full."""
    out = {}
    for i, text in docs:
        words = plain_words(text or "")
        for j, item in items:
            w = plain_words(item or "")
            if w and words and len(set(w) & set(words)) >= 0.7 * len(set(w)):
                d = edit_distance(w, words)[0]
                if d <= int(rate * len(w)):
                    out[i, j] = d
    return out


def test_query_finds_what_brute_force_finds(spark):
    docs, items = (pq.read_table(f"{DATA}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in op1_decontaminate(spark, DATA).collect()}
    want = brute(zip(docs["doc_id"], docs["text"]), list(zip(items["item_id"], items["text"])))
    assert want and got == want


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(n, " ".join(word() for _ in range(rng.randint(10, 60)))) for n in range(40)] + [(77, None), (78, " ?!"), (79, "alone")]
    docs, planted = [(5000, None), (5001, ""), (5002, "..."), (None, items[3][1])], 0
    for n in range(300):
        text = [word() for _ in range(rng.randint(0, 200))]
        if n % 3:
            w = items[n % 40][1].split()
            for _ in range(rng.randint(0, int(0.2 * len(w)))):
                at = rng.randrange(len(w))
                w[at : at + 1] = [[], [word()], [w[at], word()]][rng.randrange(3)]
            text[len(text) // 2 : len(text) // 2] = " ".join(w).upper().replace(" ", ", ").split()
        docs.append((n, " ".join(text)))
    docs += [docs[9], docs[9]]
    want = brute(docs, items)
    frame = spark.createDataFrame([(*r, 3) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for setup in (Leaks(), Leaks(block_bytes=2000)):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(frame, bench, setup).collect()}
        assert got.keys() <= want.keys()
        assert len(got) >= 0.99 * len(want) and (None, 3) in got
    assert find_leaks(frame.limit(0), bench).count() == 0
    assert find_leaks(frame, bench.limit(0)).count() == 0


def edited(rng, words, k, word):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        w[at : at + 1] = [[], [word()], [w[at], word()]][rng.randrange(3)]
    return w


def test_recall_of_copies_with_the_most_edits_at_any_length():
    rng = random.Random(7)
    for length in (1, 2, 4, 7, 9, 12, 20, 31, 60, 100, 160, 320, 500):
        word = lambda: f"w{rng.randrange(50000)}"  # noqa: B023, E731
        items = [(n, " ".join(word() for _ in range(length))) for n in range(100 if length < 200 else 20)]
        index = Index(items, Leaks())
        texts = [" ".join([word() for _ in range(20)] + edited(rng, item.split(), length // 4, word) + [word() for _ in range(20)]) for _, item in items]
        assert 0 < index.tables[length] <= Leaks().most_tables
        got = sum(n in {f[0] for f in found} for n, found in enumerate(index.search_all(texts)))
        assert got >= 0.97 * len(items)


def test_found_passages_are_the_nearest_and_few_words_repeat():
    rng, missed, every = random.Random(8), 0, 0
    for length, words in ((1, 40), (2, 5), (4, 6), (9, 12), (30, 60), (60, 900)):
        word = lambda: f"w{rng.randrange(words)}"  # noqa: B023, E731
        items = [(n, " ".join(word() for _ in range(length))) for n in range(12)]
        texts = [" ".join([word() for _ in range(20)] + edited(rng, item.split(), length // 4, word) + [word() for _ in range(20)]) for _, item in items]
        for text, found in zip(texts, Index(items, Leaks()).search_all(texts), strict=True):
            want = {}
            for m, item in items:
                d, start, end = edit_distance(item.split(), text.split())
                if d <= length // 4:
                    want[m] = d, start, end - start
            assert {m for m, *_ in found} <= want.keys() and all(d >= want[m][0] for m, d, *_ in found)
            every, missed = every + len(want), missed + sum((m, *x) not in found for m, x in want.items())
    assert missed <= 0.05 * every


def test_a_length_without_the_recall_has_every_stretch_verified():
    rng = random.Random(2)
    items = [(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(20))) for n in range(50)]
    assert Index(items, Leaks(most_tables=1)).tables == {20: 0}
    texts = [" ".join(edited(rng, item.split(), 5, lambda: "x")) for _, item in items]
    assert all(n in {f[0] for f in found} for n, found in enumerate(Index(items, Leaks(most_tables=1)).search_all(texts)))


def test_ids_of_any_type_and_a_very_long_item(spark):
    long = " ".join(f"w{n}" for n in range(20000))
    docs = spark.createDataFrame([(1, "a b c d " + long, 5), (2, "one two three four", 6), (3, "one two three five four", 6)], "doc_id int, text string, distance int")
    items = spark.createDataFrame([(7, long, 1), (8, "one two three four", 1)], "item_id smallint, text string, doc_id int")
    assert {tuple(r) for r in find_leaks(docs, items, Leaks(rate=0.1)).collect()} == {(1, 7, 0, 4, 20000), (2, 8, 0, 0, 4)}
