import random

import numpy as np
import pyarrow.parquet as pq
from conftest import DATA

from docketry.llm import near_dedup
from docketry.llm.components import components
from docketry.llm.near_dedup import Sketches
from docketry.llm.queries import op8_near_dedup


def brute(rows, words=4, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    up = {i: i for i, _ in rows if i is not None}
    most = {}
    for (i, _), s in zip(rows, sets):
        most[i] = max(most.get(i, frozenset()), s, key=len)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None:
                continue
            s, t = most[a], most[b]
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def test_query_is_brute_force(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    got = sorted((tuple(r) for r in op8_near_dedup(spark, DATA).collect()), key=str)
    assert got == brute(list(zip(docs["doc_id"], docs["text"])))


def test_chains_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, chain = [], [word() for _ in range(120)]
    for i in range(150):  # each a small change of the one before, far from the first
        chain[rng.randrange(120)] = word()
        rows.append((1000 - i, " ".join(chain)))
    base = [word() for _ in range(100)]
    for i in range(60):  # changes around one text
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(100)] = word()
        rows.append((2000 + i, " ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (None, "one two"), (None, None), (7, rows[0][1]), (7, rows[200][1]), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, n_shingles int, registers binary")
    for setup in (Sketches(words=4), Sketches(words=4, star_rounds=0, broadcast_rows=0)):
        got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs, setup).collect()), key=str)
        assert got == brute(rows)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng, setup = np.random.default_rng(1), Sketches()
    pool = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    a, b = pool[:2000], pool[500:2500]
    x, y, both = near_dedup.sketch([a, b, np.union1d(a, b)], setup)
    assert (np.maximum(x, y) == both).all()
    assert abs(near_dedup.estimate(x, y, len(a), len(b), setup) - 0.6) < 0.16


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(80, 80), (90, 80)}
