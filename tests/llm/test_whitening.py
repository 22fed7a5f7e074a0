import math
import random

import numpy as np
import pytest
from conftest import DATA

from docketry.llm import whitening
from docketry.llm.queries import op13_whitening
from docketry.llm.whitening import WhitenRules


def brute(rows, most=32):
    """By numpy over the whole table, deviations in Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return [i for i, _ in kept], n, deviation, centred @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum(), values[order]


def check(got, rows, most=32):
    ids, n, deviation, white, share, values = brute(rows, most)
    size = len(share)
    assert len(got) == len(ids) * size
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(size):
        mine = np.array([by[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine * sign - white[:, k]).max() < 1e-6, k
    for i, d in zip(ids, deviation):
        r = by[i, 1]
        assert (r["n"], r["deviation"]) == (n, d if d < 2**63 else None)
        assert r["identity_error"] < 1e-9
    assert np.allclose([by[ids[0], k + 1]["explained"] for k in range(size)], share, rtol=1e-9)


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_whitening(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(got.collect(), rows)


@pytest.mark.parametrize("rules", [WhitenRules(), WhitenRules(strip=3, block=7, held=0), WhitenRules(components=4, strip=5, block=16)])
def test_any_tiles_give_the_same(spark, rules):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(k, 1 + k) * 40 for k in range(11)]) for i in range(150)]
    rows += [(900, None), (901, [1.0] * 10 + [None]), (902, [math.nan] * 11), (903, [1.0, -math.inf] + [0.0] * 9), (904, [0.5] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n int").repartition(5)
    check(whitening.whiten(frame, rules).collect(), [r for r in rows if r[0] != 904], rules.components)


def test_odd_tables(spark):
    rows = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>")
    assert whitening.whiten(rows([])).collect() == []
    assert whitening.whiten(rows([(1, []), (2, None)])).collect() == []
    one = whitening.whiten(rows([(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    same = whitening.whiten(rows([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])])).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["explained"]) for r in same if r["component"] == 1] == [(1, 3, 128**2, 1.0), (1, 3, 128**2, 1.0), (None, 3, 256**2, 1.0)]
    assert all(r["whitened"] is None for r in same if r["component"] == 2)
    assert all(r["identity_error"] < 1e-12 for r in same)


def test_large_entries(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1e6, 1e6), rng.uniform(-1, 1), 5.0 + i % 2]) for i in range(80)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
    with pytest.raises(Exception, match="fit a long"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")).collect()
