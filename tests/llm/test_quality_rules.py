import random
from collections import Counter
from math import comb

import pyarrow.parquet as pq
import pytest
from conftest import DATA

from docketry.llm import quality_rules as q
from docketry.llm.queries import op7_quality_rules


def plain(text):
    """The counts by the words of the contract, one by one."""
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


TEXTS = [None, "", " \n\t", "a b", "a b a b a b a", "x\ny\nx\n\n \n \nx", "é|#ü <b>\x0bq\x0cr\x1cs\xa0t", "same same same same", "one two three four one two three", "w " * 5000]


def test_counts():
    for text in TEXTS:
        assert q.measure(text or "")[:5] == plain(text), text


def test_query_base_is_brute_force(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    rows = {r["doc_id"]: r for r in op7_quality_rules(spark, DATA).collect()}
    for i, text in zip(docs["doc_id"], docs["text"]):
        want = plain(text)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert tuple(rows[i])[1:7] == (*want, failed) and not (failed and rows[i]["kept"])


def test_tail_is_the_binomial():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.2), (12, 50, 0.3)):
        assert q.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_are_proven_and_reject_bad_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(80)) for _ in range(1500)]
    bad = [" | ".join(word() for _ in range(80)) for _ in range(80)]
    rows = [(i, t, 1, None) for i, t in enumerate(good)] + [(10_000 + i, t, 0, None) for i, t in enumerate(bad)]
    rows += [(None, good[0], None, None), (77, None, None, None), rows[0]]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t, _, _ in rows], "doc_id long, text string, kept boolean, n_words int")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(1, None), (None, 0)], "doc_id long, quality int")
    found = q.quality_rules(docs, labels).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert sum(kept[i] for i in range(1500)) >= 0.95 * 1500 and not any(kept[10_000 + i] for i in range(80)) and not kept[77]
    assert q.keep_good(docs, labels).count() == sum(r["kept"] for r in found)
    none = q.quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert q.quality_rules(docs.limit(0), labels).count() == 0


def test_few_labels_prove_nothing():
    counts = {(0, "symbols", 1, 0): 50, (0, "symbols", 0, 60): 50}
    assert q.choose_cutoffs(counts, q.RiskRules(), list(q.signals())) == {}
