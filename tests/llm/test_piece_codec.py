import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from conftest import DATA

from docketry.llm.piece_codec import SPACE, Codec, encode_pieces
from docketry.llm.queries import op10_piece_codec

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " a", "a ", "  a  b \n\n c\t", "Is ndble whst the by for.\nÈre, tionç", "▁ a▁b ▁", "日本語 😀 ﬁ", "\n", "\x00\x7f", "the " * 50, "e" * 100, "ab" * 200, "internationalization" * 5]


def brute(codec, text):
    """The whole search at once: the best sum over all covers."""
    marked = (" " + text).replace(SPACE, "\0").replace(" ", SPACE)
    best = [(0.0, 0, None)] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - codec.longest), end):
            found = codec.piece.get(marked[start:end])
            options = [(best[start][0] + found[1], start, [found[0]])] if found else []
            if end - start == 1:
                spelled = SPACE if marked[start] == "\0" and SPACE in text else marked[start]
                options.append((best[start][0] + codec.spelled, start, [codec.byte[b] for b in spelled.encode()]))
            for o in options:
                if best[end] is None or o[0] > best[end][0]:
                    best[end] = o
    out, end = [], len(marked)
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for part in reversed(out) for i in part] if text else []


def test_streaming_is_the_whole_search():
    codec, rng = Codec(FILE), random.Random(3)
    made = ["".join(rng.choice("eatsino  \nthéü▁,") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for text in TEXTS + made:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == brute(codec, text), text
        assert codec.decode(codec.encode(text)) == text


def test_portions_are_committed_early():
    codec = Codec(FILE)
    portions = list(codec.stream((SPACE + "word") * 500))
    assert len(portions) > 20 and max(map(len, portions)) < 100


def test_query_is_the_whole_search_for_every_text(spark):
    codec, texts = Codec(FILE), pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: (r["n_ids"], r["ids_crc32"]) for r in op10_piece_codec(spark, DATA).collect()}
    short = [d for d in texts if len(d["text"] or "") < 3000]
    assert len(short) > 100
    for d in short:
        ids = np.array(brute(codec, d["text"] or ""), "<u4")
        assert got[d["doc_id"]] == (len(ids), zlib.crc32(ids.tobytes()))


def test_query_restores_every_text(spark):
    rows = op10_piece_codec(spark, DATA).collect()
    assert len(rows) == 200 and all(r["restored"] and r["n_id_bytes"] == 4 * r["n_ids"] for r in rows)


def test_odd_rows(spark):
    rows = [*enumerate(TEXTS), (None, None), (50, "long text, " * 20000), (3, TEXTS[3])]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, n_ids int, ids binary")
    found = encode_pieces(docs, FILE).collect()
    assert len(found) == len(rows) and all(r["restored"] for r in found)
    assert encode_pieces(docs.limit(0), FILE).count() == 0
