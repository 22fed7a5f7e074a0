import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from conftest import DATA
from tokenizers import Tokenizer

from docketry.llm.common import shared_dir
from docketry.llm.queries import op4_wavelet_tokens
from docketry.llm.wavelet_tokens import Encoder, WaveletMatrix, count_tokens, locate_tokens, token_table, tokens_at, write_shards

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "\na", "it's  we'll\tso", "x y z", "né ça\nva 12 34.5!\nok", "a \nb", "<|endoftext|> x", "日本 語\n😀  q", "foo, bar. foo\nbar! x\n\n\n", "word's. it's, can't!\nI'll", "a.. b?! 1, 2.", "a\0b c", "x²! y₂, z", "a\u0085 b", "a\x1c b", "é! ñ, ü.\nö;"]


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(FILE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_query_is_the_tokenizer(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    assert sorted((tuple(r) for r in op4_wavelet_tokens(spark, DATA).collect()), key=str) == expected(list(zip(docs["doc_id"], docs["text"])))


def test_odd_rows(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id"), (99, None), (100, "long text " * 30000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    assert sorted((tuple(r) for r in token_table(docs, FILE, 2).collect()), key=str) == expected(rows)
    assert token_table(docs.limit(0), FILE, 2).count() == 0


def test_remembered_words_give_the_same_ids():
    texts = [*ODD, "one two\nthree four, one", "a b\nc"]
    assert Encoder(FILE).encode(texts) == Encoder(FILE, remember=False).encode(texts)


def test_matrix_access_rank_select():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 3000) % 60000
    m = WaveletMatrix.build(ids)
    m = WaveletMatrix(m.n, [p.tobytes() for p in m.planes], m.zeros, [x.astype("<u4").tobytes() for x in m.ones])
    assert (m.ids() == ids).all()
    assert [m.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for v in (1, 2, int(ids[-1]), 59999):
        places = np.flatnonzero(ids == v)
        assert m.count(v) == len(places) and m.rank(v, 1500) == (places < 1500).sum()
        assert m.select(v, 0, 9999).tolist() == places.tolist() and m.select(v, 1, 3).tolist() == places[1:3].tolist()
        assert m.select(v, len(places), len(places) + 1).tolist() == []
    assert WaveletMatrix.build(np.empty(0, int)).ids().tolist() == []


def test_counts_places_and_tokens_of_shards(spark):
    rows = [(n, f"word {n} other words, word\nend {'the ' * n}") for n in range(40)] + [(None, None), (77, "")]
    path = shared_dir(spark, "shards")
    write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), FILE, 2, path)
    shards, tokenizer = spark.read.parquet(path), Tokenizer.from_file(FILE)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    asked = [2, tokenizer.token_to_id("Ġword"), tokenizer.token_to_id("Ġthe"), 50255, 70000]
    want = {(x, i, p) for i, own in ids.items() for p, x in enumerate(own) if x in asked}
    assert {tuple(r) for r in locate_tokens(shards, asked).collect()} == want
    assert {r["token_id"]: r["n"] for r in count_tokens(shards, asked + asked).collect()} == {x: sum(w[0] == x for w in want) for x in asked}
    assert {r["n"] for r in count_tokens(shards.limit(0), asked).collect()} == {0}
    places = [(i, p) for i in (0, 7, 39, 77) for p in (0, 3, 10, 500, -1)] + [(1000, 0), (None, 0)]
    got = {(r["doc_id"], r["place"]): r["token_id"] for r in tokens_at(shards, spark.createDataFrame(places, "doc_id long, place int")).collect()}
    assert got == {(i, p): ids[i][p] if 0 <= p < len(ids[i]) else None for i, p in places if i in ids and i is not None}


def test_generations_of_remembered_words(monkeypatch):
    from docketry.llm import wavelet_tokens

    monkeypatch.setattr(wavelet_tokens, "_CACHED", 8)
    monkeypatch.setattr(wavelet_tokens, "_KNOWN", {})
    encoder, plain = Encoder(FILE), Encoder(FILE, remember=False)
    for k in range(12):
        texts = [f"the word{k % 5} and, more{k}!\nlines the", f"  odd  {k} the", "the " * 30 + "end."]
        assert encoder.encode(texts) == plain.encode(texts)
        assert len(encoder.older) <= 30
