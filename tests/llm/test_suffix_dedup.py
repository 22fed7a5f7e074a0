import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
from conftest import DATA

from docketry.llm import suffix_dedup
from docketry.llm.queries import op2_suffix_dedup


def brute(texts, length):
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_is_brute_force(spark):
    rows = {r[0]: tuple(r)[1:] for r in op2_suffix_dedup(spark, DATA).collect()}
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    assert [rows[i] for i in docs["doc_id"]] == brute([(t or "").encode() for t in docs["text"]], 200)


def made_up():
    rng = random.Random(5)
    passage = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (60, 90, 150)]
    rows = [(i, "".join(rng.choice([*passage, "".join(rng.choice("xyzü") for _ in range(rng.randint(1, 60)))]) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    return [*rows, (90, None), (91, ""), (92, "a" * 500), rows[0], rows[0], (None, "q" * 39), (None, "q" * 39), (95, "z" * 30)]


def test_cases_by_tree_and_by_window_hash(spark):
    rows = made_up()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _h int, kept int")
    want = Counter(zip([r[0] for r in rows], brute([(r[1] or "").encode() for r in rows], 40)))
    for most in (1000, 2):
        found = suffix_dedup.remove_repeats(docs, 40, most).collect()
        got = Counter((r["doc_id"], (len((r["text"] or "").encode()), sum(x.end - x.start for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())) for r in found)
        assert got == want


def test_crowded_near_copies_are_halved_only_until_a_tree_holds_them(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    texts = []
    for _ in range(80):
        text = list(base)
        for place in rng.sample(range(400), 12):
            text[place] = rng.choice("XYZÄ")
        texts.append("".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = Counter(), suffix_dedup.staged

    def counted(df, name):
        out = real(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counted)
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 60, 16).collect()}
    got = [(len(found[i]["text"].encode()), sum(x.end - x.start for x in found[i]["spans"]), len(found[i]["spans"]), hashlib.sha256(found[i]["kept"]).hexdigest()) for i in range(80)]
    assert got == brute([x.encode() for x in texts], 60)
    # A block a window would be up to 29 rows a context.
    assert made["contexts"] and made["blocks"] < 2 * made["contexts"]


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    text += text[100:900]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 256)
    small = suffix_dedup.find_anchors(text, 60)
    owned = [i for a, b in zip(small.first, small.last) for i in range(a, b + 1)]
    assert owned == list(range(len(text) - 59))
    monkeypatch.undo()
    whole = suffix_dedup.find_anchors(text, 60)
    place = lambda a: {s: p for p, x, y in zip(a.place, a.first, a.last) for s in range(x, y + 1)}
    assert place(small) == place(whole)


def test_whole_characters_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é" * 100), (2, "x" + "é" * 60 + "y")], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs, 41, whole_characters=True).collect():
        r["kept"].decode()
    assert suffix_dedup.remove_repeats(docs.limit(0), 41).count() == 0


def test_interval_tree_groups():
    a, b, c = b"0123456789abcdefgh", b"x123456789abcdefzz", b"y1234567890000"
    found = suffix_dedup.maximal_repeats([a, b, c], [1, 1, 1], 6)
    assert [suffix_dedup.merged(x) for x in found] == [[(1, 16)], [(1, 16)], [(1, 10)]]
