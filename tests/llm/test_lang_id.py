import math
import zlib

import pyarrow.parquet as pq
import pytest
from conftest import DATA

from docketry.llm import lang_id
from docketry.llm.queries import op5_language_id


def slow_bits(texts, text):
    """The code length of a text after learning others, straight from the definition."""
    counts = {}
    for t in texts:
        x = b"\0\0\0" + t
        for i in range(3, len(x)):
            counts.setdefault(x[i - 3 : i], []).append(x[i])
    pools = [{}, {}, {}, {}]
    for context, seen in counts.items():
        for k in range(4):
            pool = pools[k].setdefault(context[3 - k :], {})
            for s in seen:
                pool[s] = pool.get(s, 0) + 1

    total, x = 0.0, b"\0\0\0" + text
    for i in range(3, len(x)):
        share, at = 1.0, None
        for k in range(3, -1, -1):
            pool = pools[k].get(x[i - k : i])
            if pool:
                n, d = sum(pool.values()), len(pool)
                if x[i] in pool:
                    at = pool[x[i]] / (n + d)
                    break
                share *= d / (n + d)
        total -= math.log2(share * (at if at is not None else 1 / 257))
    return total


def test_code_lengths_are_the_definition():
    learned = {"aa": [b"the cat sat on the mat", b"that hat"], "bb": [b"la la lo li", "été à la".encode()]}
    grams = __import__("pandas").concat([lang_id.count_grams(t).assign(lang=k) for k, t in learned.items()])
    costs = lang_id.build_costs(grams)
    for text in (b"the mat", b"la lo", "zz été qq".encode(), b"\xff\x00a", b"t"):
        got = lang_id.code_lengths([text, b"", b"other", text * 3], costs)
        assert got[0].tolist() == pytest.approx([slow_bits(learned[k], text) for k in costs.languages], rel=1e-5)
        assert got[1].tolist() == [0, 0]


def test_long_texts_are_summed_in_pieces(monkeypatch):
    costs = lang_id.build_costs(lang_id.count_grams([b"some words in a text"]).assign(lang="x"))
    text = b"words in some text and more words " * 50
    whole = lang_id.code_lengths([text], costs)
    monkeypatch.setattr(lang_id, "_PIECE", 100)
    assert lang_id.code_lengths([b"a", text, b"b"], costs)[1].tolist() == pytest.approx(whole[0].tolist())


def test_held_out_accuracy(spark):
    lang = dict(zip(*pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values()))
    rows = op5_language_id(spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, score string"
    learn = spark.createDataFrame([(1, "the cat and the dog", "en", ""), (2, "le chat et le chien", "fr", ""), (3, "x", None, ""), (4, None, "en", "")], kinds)
    docs = spark.createDataFrame([(1, None, None, "s"), (2, "", None, "s"), (3, "12 !?", None, "s"), (None, "le chien", None, "s"), (5, "the dog " * 90000, None, "s"), (5, "the dog", None, "s"), (5, "the dog", None, "s")], kinds)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in lang_id.predict_languages(docs, lang_id.train(learn)).collect())
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en"), (5, "en")]
    assert lang_id.train(learn.limit(0)) is None
    assert {r["lang_pred"] for r in lang_id.predict_languages(docs, None).collect()} == {"und"}
    assert lang_id.predict_languages(docs.limit(0), lang_id.train(learn)).count() == 0


def test_query_is_the_definition(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    pools = {}
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2 and d["lang"] and d["text"] is not None:
            own, x = pools.setdefault(d["lang"], [{}, {}, {}, {}]), b"\0\0\0" + d["text"].encode()
            for i in range(3, len(x)):
                for k in range(4):
                    pool = own[k].setdefault(x[i - k : i], {})
                    pool[x[i]] = pool.get(x[i], 0) + 1
    own = [p for p in pools.values()]
    assert all(len(p[0][b""]) for p in own)

    def bits(text, pool):
        total, x = 0.0, b"\0\0\0" + text
        for i in range(3, len(x)):
            share, at = 1.0, 1 / 257
            for k in range(3, -1, -1):
                seen = pool[k].get(x[i - k : i])
                if seen:
                    size = sum(seen.values()) + len(seen)
                    if x[i] in seen:
                        at = seen[x[i]] / size
                        break
                    share *= len(seen) / size
            total -= math.log2(share * at)
        return total

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op5_language_id(spark, DATA).collect()}
    some = [d for d in docs if 50 < len(d["text"] or "") < 1500][:60]
    assert len(some) > 20
    for d in some:
        lengths = {k: bits(d["text"].encode(), p) for k, p in pools.items()}
        least = min(lengths.values())
        if any(c.isalpha() for c in d["text"]):
            assert got[d["doc_id"]][0] == min(lengths, key=lambda k: (lengths[k], k))
            assert got[d["doc_id"]][1] == pytest.approx(1 / sum(2 ** -min(v - least, 1000) for v in lengths.values()), rel=1e-3)


def test_no_language_is_lost_to_equal_rows(spark):
    rows = [(None, f"words of tongue{k} all alike", f"l{k}") for k in range(13) for _ in range(1000)] + [(1, "few words", "zz")]
    costs = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(costs.languages) == 14


def test_signs_of_numbers_are_no_letters(spark):
    costs = lang_id.train(spark.createDataFrame([(1, "en", "the quick brown fox"), (2, "fr", "le renard brun")], "doc_id long, lang string, text string"))
    signs = ["½", "² ³", "Ⅷ ⅷ 12", "①", "½a", "ª", "字"]
    docs = spark.createDataFrame(list(enumerate(signs)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] == "und" for r in lang_id.predict_languages(docs, costs).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
