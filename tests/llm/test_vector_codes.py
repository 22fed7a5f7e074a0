import hashlib
import math
import random

import numpy as np
from conftest import DATA

from docketry.llm import vector_codes
from docketry.llm.common import attach
from docketry.llm.queries import op11_vector_codes
from docketry.llm.vector_codes import CodeRules


def brute(rows, entries=256, rounds=4):
    """Every distance in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    parts = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    size = len(parts[0]) // 4 if parts else 0
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[parts[i][p * size : (p + 1) * size] for i in order[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [[min((far(v[p * size : (p + 1) * size], c), e) for e, c in enumerate(books[p])) for p in range(4)] for v in parts]
        if turn < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [v[p * size : (p + 1) * size] for v, f in zip(parts, found) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found] if parts else []
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), d, by[label], sha) for (i, _, label), f, d in zip(kept, found, errors)), key=str) if parts else []


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op11_vector_codes(spark, DATA)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[3][1], None), (400, None, 1), (401, [1.0] * 7 + [None], 1), (402, [math.nan] + [0.0] * 7, 1), (403, [math.inf] * 8, 2), (404, [-1e-9] * 8, 2)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    for entries in (256, 5):
        got = sorted(map(tuple, vector_codes.vector_codes(frame, CodeRules(entries=entries, leaf=3)).collect()), key=str)
        assert got == brute(rows, entries)
    assert vector_codes.vector_codes(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [2.0] * 6, 1), (4, [2.0] * 12, 1), (5, [], None)], frame.schema[:3])
    assert [r["vec_id"] for r in vector_codes.vector_codes(odd).orderBy("vec_id").collect()] == [1, 2]


def test_large_components_are_exact_and_what_fits_no_long_is_an_error(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-40_000, 40_000) for _ in range(8)], 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vector_codes.vector_codes(frame, CodeRules(entries=9)).collect()), key=str) == brute(rows, 9)


def test_the_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(2)
    for width in (1, 3, 16):
        entries, parts = (rng.integers(-3, 4, (n, width)).astype(np.float64) for n in (200, 500))
        at, far = vector_codes.nearest(vector_codes.kd_tree(entries, leaf=4), parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(-1)
        assert (far == every.min(1)).all() and (at == every.argmin(1)).all()


def test_attached_totals_are_the_same_by_either_way(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 5) for i in range(200)], "n long, k int")
    totals = rows.groupBy("k").count()
    by = [sorted(map(tuple, attach(rows, totals, ["k"], "n", most).collect()), key=str) for most in (1 << 20, 0)]
    assert by[0] == by[1] and len(by[0]) == 200 and all(c for _, _, c in by[0])
