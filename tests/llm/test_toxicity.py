import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from conftest import DATA
from pyspark.sql import functions as F

from docketry.llm import toxicity
from docketry.llm.queries import op9_toxicity

INSULTS = ["grumblecrust", "snotbucket", "wretchling", "oafhead"]


def made(n, seed):
    rng, words = random.Random(seed), [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS).title() + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_unseen_documents_are_told_apart(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    other = made(400, 2)
    odd = [(9001, None, 0), (9002, "", 0), (None, "word1 word2", 0), (9003, "word1 " * 50000, 0), other[1], other[1]]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t, _ in other + odd], "doc_id long, text string, score double")
    got = [(r["doc_id"], r["predicted"], r["score"]) for r in toxicity.score_toxicity(frame, model).collect()]
    assert len(got) == len(other) + len(odd) and all(0 <= s <= 1 and (s >= 0.5) == p for _, p, s in got)
    truth = {i: y for i, _, y in other + odd}
    assert sum(p == truth[i] for i, p, _ in got) >= 0.97 * len(got)
    assert toxicity.score_toxicity(frame.limit(0), model).count() == 0
    assert (model[0] != 0).sum() < 2000


def test_no_labels_give_even_scores(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score_toxicity(docs, model).collect()] == [0.5]


def test_features_ignore_case_and_edges():
    h = toxicity.Hashes()
    assert (toxicity.features(b"Bad, WORD!", h, 20) == toxicity.features(b"bad word", h, 20)).all()
    assert len(toxicity.features(b"a b c d e", h, 20)) == 5 + 4 + 3 + 2 and len(toxicity.features(b"", h, 20)) == 0


def test_ftrl_keeps_useless_weights_at_zero():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 500, 20), [900] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(300)]
    w, _ = toxicity.fit([(r.astype(np.int64), y) for r, y in rows], toxicity.Ftrl(bits=10))
    assert w[900] > 1 and (w != 0).sum() < 120


def test_query_is_one_model_over_every_document(spark):
    """The rows by a model fitted here, and how it does on labels that it never saw."""
    data = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (pq.read_table(f"{data}/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    text, held = dict(zip(docs["doc_id"], docs["text"])), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    toxic = dict(zip(labels["doc_id"], labels["toxic"]))
    got = {r["doc_id"]: r for r in op9_toxicity(spark, data).collect()}
    assert got.keys() == text.keys() and all(r["held_out"] == held(i) and (r["score"] >= 0.5) == r["predicted"] for i, r in got.items())
    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in toxic], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    hashes, setup = toxicity.Hashes(), toxicity.Ftrl()
    of = lambda i: toxicity.features((text[i] or "").encode(), hashes, setup.bits).astype(np.int64)
    w, bias = toxicity.fit([(of(i), toxic[i]) for i in sorted((i for i in toxic if not held(i) and toxic[i] in (0, 1)), key=order.get)], setup)
    for i in list(text)[:300]:
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-(w[of(i)].sum(dtype=np.float64) + bias)))) < 1e-5
    unseen = [i for i in toxic if held(i)]
    assert sum(got[i]["predicted"] == toxic[i] for i in unseen) >= 0.9 * len(unseen)
