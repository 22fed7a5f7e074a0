from collections import Counter
from math import log2

import pyarrow.parquet as pq
import pytest
from conftest import DATA

from docketry.llm.cross_entropy import Matched, score_documents
from docketry.llm.queries import op6_cross_entropy


def brute(rows, goal, setup):
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    size, models = len({w for _, t in texts for w in t}), []
    texts = [(i, [None, *t]) for i, t in texts]
    for own in ([t for i, t in texts if i in goal and i is not None], [t for _, t in texts]):
        models.append((Counter(p for t in own for p in zip(t, t[1:])), Counter(v for t in own for v in t[:-1]), Counter(w for t in own for w in t[1:])))
    out = []
    for i, t in texts:
        h = []
        for pairs, before, words in models:
            n = sum(words.values())
            bits = [-log2((pairs[v, w] + setup.mu * (words[w] + 1) / (n + size)) / (before[v] + setup.mu)) for v, w in zip(t, t[1:])]
            h.append(sum(bits) / len(bits) if bits else 0.0)
        out.append((i, len(t) - 1, *h, h[0] - h[1]))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], abs=1e-6)


def test_query_is_brute_force(spark):
    docs, labels = (pq.read_table(f"{DATA}/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    goal = {i for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1}
    same(op6_cross_entropy(spark, DATA).collect(), brute(list(zip(docs["doc_id"], docs["text"])), goal, Matched()))


def test_cases(spark):
    rows = [(1, "a b a c"), (2, None), (3, ""), (4, "A\tb\nrare words here a"), (4, "a b a"), (None, "b a"), (6, "c " * 3000), (1, "a b a c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    goal = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    for setup in (Matched(mu=3), Matched(page_tokens=100)):
        same(score_documents(docs, goal, setup).collect(), brute(rows, {1}, setup))
        same(score_documents(docs, goal.limit(0), setup).collect(), brute(rows, set(), setup))
    assert score_documents(docs.limit(0), goal).count() == 0


def test_every_word_counts_however_many_there_are(spark):
    rows = [(n, " ".join(f"w{n * 700 + k} w{n * 700 + k + 1}" for k in range(700))) for n in range(100)]
    assert len({w for _, t in rows for w in t.split()}) > 65_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(n,) for n in range(0, 100, 3)], "doc_id long")
    every = brute(rows, set(range(0, 100, 3)), Matched())
    for setup in (Matched(), Matched(page_tokens=30_000)):
        same(score_documents(docs, goal, setup).collect(), every)
