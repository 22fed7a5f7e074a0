"""Token ids in wavelet-matrix shards.

A shard file is Parquet with one row a segment.  A segment holds the ids of
whole documents, one after another, as a wavelet matrix: plane ``k`` has bit
``k`` (highest first) of every id, stably parted by the bits above it, with the
ones before each block stored beside it.  From the planes and these counts one
can read a token (:func:`tokens_at`), count an id (:func:`count_tokens`) and find
its occurrences (:func:`locate_tokens`) without decoding the rest.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import giving_back, shared_dir, text_of

BITS = 16
BLOCK = 512
SEGMENT_TOKENS = 1 << 19
#: Pieces in each of the two generations that a worker remembers, and documents in a batch.
_CACHED, _DOCUMENTS = 60_000, 256
_ODD_SPACE = re.compile(r"[^\S \n]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_CUT = re.compile(r"(?<=[\w!-~])(?=[ \n])")
_MARKS = ".,;:!?"


@functools.cache
def _tokenizer(file: str):
    """Loaded once a worker; the library holds on to what it frees."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class WaveletMatrix:
    """``planes[k]``: packed bits; ``zeros[k]``: zeros in the plane; ``ones[k]``: ones before each block of it."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ones: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ones = [np.frombuffer(x, "<u4").astype(np.int64) for x in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> WaveletMatrix:
        x, planes, zeros, ones = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        for k in range(bits - 1, -1, -1):
            bit = (x >> k & 1).view(np.uint16 if bits <= 16 else np.uint32).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane.tobytes())
            zeros.append(len(x) - int(np.count_nonzero(bit)))
            blocks = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
            ones.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
            x = np.concatenate([x[~bit], x[bit]])
        return cls(len(ids), planes, zeros, ones)

    def ids(self) -> np.ndarray:
        """All ids in order: the partings are undone from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[~bit] = out[:z]
            up[bit] = out[z:] | (1 << k)
            out = up
        return out

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k: the stored count of the block, and what stands in it before i."""
        block = min(i, self.n - 1) // BLOCK if self.n else 0
        inside = np.unpackbits(self.planes[k][block * BLOCK // 8 : (i + 7) // 8], count=i - block * BLOCK, bitorder="little")
        return (int(self.ones[k][block]) if self.n else 0) + int(inside.sum())

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The places of the nth bits of one kind in plane k: the block by the stored counts, then inside it."""
        before = self.ones[k] if bit else np.arange(len(self.ones[k])) * BLOCK - self.ones[k]
        block = np.searchsorted(before, nth, "right") - 1
        rows = np.resize(np.append(self.planes[k], np.zeros(-len(self.planes[k]) % (BLOCK // 8), np.uint8)), (len(before), BLOCK // 8))
        here = np.unpackbits(rows[block], axis=1, bitorder="little") == bit
        return block * BLOCK + (np.cumsum(here, 1, dtype=np.int16) == (nth - before[block] + 1)[:, None]).argmax(1)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value, i = value << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value among the first i ids stand below the lowest plane."""
        low = 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, low), self._rank1(k, i)
            low, i = (self.zeros[k] + a, self.zeros[k] + b) if value >> (len(self.planes) - 1 - k) & 1 else (low - a, i - b)
        return low, i

    def rank(self, value: int, i: int) -> int:
        """How often value stands among the first i ids."""
        low, high = self._range(value, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, first: int, last: int) -> np.ndarray:
        """The places of the occurrences of value from number ``first`` (0 is the first) to before ``last``, as far as there are any."""
        low, high = self._range(value, self.n)
        at = np.arange(low + first, min(low + last, high))
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = np.concatenate([self._select(k, bit, x - bit * self.zeros[k]) for x in np.array_split(at, max(1, len(at) // 4096))]) if len(at) else at
        return at


#: The pieces known to this worker, younger and older generation: kept from task to task, by tokenizer file.
_KNOWN: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


class Encoder:
    """Ids of whole texts by a tokenizers file, as bytes of unsigned 16-bit integers.

    The pre-tokenizer never joins what stands before white space with what
    follows, so a text is cut there and each piece encoded once and remembered.
    When a generation of pieces is full it becomes the older one, and those of it
    that are met again move to the new one, so frequent pieces stay.  Where all white space is single spaces and line
    ends between words, a piece is a word, with its space unless a line end is
    in front; other texts are cut before spaces and line ends after a visible
    character.  Nor is a letter joined with a mark after it, so a word's marks
    at the end are looked up apart.
    """

    def __init__(self, tokenizer_file: str, remember: bool = True):
        self.tokenizer = _tokenizer(tokenizer_file)
        if self.tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError(f"ids of more than {BITS} bits")
        self.known, self.older = _KNOWN.setdefault(tokenizer_file, ({}, {}))
        self.file = tokenizer_file
        #: How the vocabulary writes bytes: those without a visible Latin-1 character get the numbers from 256, in order.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.shown = {b: 256 + n for n, b in enumerate(hidden)}
        self.remember = remember

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Remember words that stand behind a space, line end in front included, and pieces marked by a zero byte."""
        known, merge, shown, some, marked = self.known, self.tokenizer.model.tokenize, self.shown, [], []

        def learn(w: str) -> None:
            if w.isalpha():  # one word of the pre-tokenizer, which needs only the merges
                known[w] = array("H", [x.id for x in merge("\u0120" + (w if w.isascii() else w.encode().decode("latin-1").translate(shown)))]).tobytes()
            else:
                some.append(w)

        for w in new:
            if w[-1:] in _MARKS and (core := w.rstrip(_MARKS))[-1:].isalpha():
                marked.append((w, core))
                if core not in known and core not in new:
                    learn(core)
            else:
                learn(w)
        for low in range(0, len(some), 4096):
            part = some[low : low + 4096]
            known.update(zip(part, self._whole([w if w[:1] == "\n" else w[1:] if w[:1] == "\0" else " " + w for w in part]), strict=True))
        for w, c in marked:
            marks = "\0" + w[len(c) :]
            if marks not in known:
                known[marks] = self._whole([marks[1:]])[0]
            known[w] = known[c] + known[marks]

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those that neither generation knows; all others are in the younger one afterwards."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > _CACHED:
            self.known, self.older = _KNOWN[self.file] = {}, self.known
            new = pieces
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        return new - again

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.remember:
            return self._whole(texts)
        pieces = []
        for t in texts:
            if "\0" in t or not t:
                pieces.append([])
            elif _ODD_SPACE.search(t) or t[0] in " \n" or t[-1] in " \n" or any(x in t for x in _PAIRS):
                pieces.append(["\0" + x for x in _CUT.split(t)])
            else:
                words = t.replace("\n", " \n").split(" ")
                words[0] = "\0" + words[0]
                pieces.append(words)
        self._learn(self._unknown(set(chain.from_iterable(pieces))))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) if words else self._whole([t])[0] for words, t in zip(pieces, texts, strict=True)]


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Write the ids of ``docs`` (doc_id, text) to shards at ``path`` in ascending order of id.

    Null texts count as empty; rows of one id are ordered by their text, and
    rows without id come first.  A shard is what one task writes; a segment is
    closed at the first document that brings it to SEGMENT_TOKENS.
    """
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(tokenizer_file), TaskContext.get().partitionId()
        segment, ids, parts, size = 0, [], [], 0

        def row() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u2"))
            lengths = [len(p) // 2 for p in parts]
            values = {"shard": shard, "segment": segment, "n_tokens": matrix.n, "doc_ids": ids, "lengths": lengths, "zeros": matrix.zeros, "planes": [p.tobytes() for p in matrix.planes], "ones": [x.astype("<u4").tobytes() for x in matrix.ones]}
            types = {"shard": pa.int32(), "segment": pa.int32(), "n_tokens": pa.int64(), "doc_ids": pa.list_(batch.schema.field("doc_id").type), "lengths": pa.list_(pa.int64()), "zeros": pa.list_(pa.int64()), "planes": pa.list_(pa.binary()), "ones": pa.list_(pa.binary())}
            return pa.RecordBatch.from_pydict({k: pa.array([v], types[k]) for k, v in values.items()})

        for batch in batches:
            for name, coded in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(name)
                parts.append(coded + end)
                size += len(coded) // 2 + 1
                if size >= SEGMENT_TOKENS:
                    yield row()
                    segment, ids, parts, size = segment + 1, [], [], 0
        if parts:
            yield row()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    shards = ordered.mapInArrow(giving_back(encode), f"shard int, segment int, n_tokens long, doc_ids array<{id_type}>, lengths array<long>, zeros array<long>, planes array<binary>, ones array<binary>")
    # Small batches keep whole texts from piling up beside the pieces that a worker remembers.
    size, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession
    before = spark.conf.get(size)
    spark.conf.set(size, _DOCUMENTS)
    try:
        shards.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(size, before)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A segment at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _documents(r: dict) -> list[bytes]:
    """The ids of a segment's documents, as unsigned 32-bit little-endian numbers."""
    ids, ends = _matrix(r).ids().astype("<u4"), np.cumsum(r["lengths"])
    return [ids[a:b].tobytes() for a, b in zip(ends - r["lengths"], ends, strict=True)]


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode shards: shard, segment, doc_id, inside (ids of the segment before the document), n_tokens, ids (unsigned 32-bit, little-endian)."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    kind, columns = to_arrow_type(id_type), ["shard", "segment", "doc_id", "inside", "n_tokens", "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n = len(r["lengths"])
            keys = [pa.array([r[k]] * n, pa.int32()) for k in ("shard", "segment")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(r["doc_ids"], kind), pa.array(np.cumsum(r["lengths"]) - r["lengths"]), pa.array(r["lengths"], pa.int64()), pa.array(_documents(r), pa.binary())], columns)

    return shards.mapInArrow(giving_back(decode), f"shard int, segment int, doc_id {id_type.simpleString()}, inside long, n_tokens long, ids binary")


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ones"])


def count_tokens(shards: DataFrame, ids: list[int]) -> DataFrame:
    """Rows (token_id, n): how often each of ``ids`` stands in all shards, by rank; nothing is decoded.

    A repeated id counts once; an id that stands nowhere, or in no shard, has n = 0.
    """
    asked = sorted(set(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in map(_matrix, _rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([m.count(x) if x >> len(m.planes) == 0 else 0 for x in asked], pa.int64())], ["token_id", "n"])

    every = shards.sparkSession.createDataFrame([(x, 0) for x in asked], "token_id int, n long")
    found = shards.select("n_tokens", "zeros", "planes", "ones").mapInArrow(giving_back(run), "token_id int, n long")
    return found.union(every).groupBy("token_id").agg(F.sum("n").alias("n"))


def locate_tokens(shards: DataFrame, ids: list[int]) -> DataFrame:
    """Rows (token_id, doc_id, place): every occurrence of ``ids``, place from 0 in its document, by select; nothing is decoded."""
    asked, id_type = sorted(set(ids)), shards.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            m, ends = _matrix(r), np.cumsum(r["lengths"])
            for x in asked:
                count = m.count(x) if x >> len(m.planes) == 0 else 0
                for low in range(0, count, 1 << 16):
                    at = m.select(x, low, low + (1 << 16))
                    doc = np.searchsorted(ends, at, "right")
                    columns = [pa.array(np.full(len(at), x, np.int32)), pa.array([r["doc_ids"][d] for d in doc.tolist()], kind), pa.array(at - (ends - r["lengths"])[doc])]
                    yield pa.RecordBatch.from_arrays(columns, ["token_id", "doc_id", "place"])

    return shards.select("n_tokens", "doc_ids", "lengths", "zeros", "planes", "ones").mapInArrow(giving_back(run), f"token_id int, doc_id {id_type.simpleString()}, place long")


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc_id, place) with token_id, by access; null where the document has no such place, no row without the document.

    Places are asked of the segment that holds their document, so only these segments are read.
    """
    keys = ["shard", "segment"]
    docs = shards.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("number", "own"))
    docs = docs.select("of_shard", "of_segment", "number", F.col("own.doc_ids").alias("doc_id"), F.col("own.lengths").alias("n"))
    asked = places.select("doc_id", F.col("place").cast("long").alias("place")).join(docs, "doc_id")
    id_type = places.schema["doc_id"].dataType.simpleString()

    def run(asked: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(segment):
            return pd.DataFrame({"doc_id": [], "place": [], "token_id": []})
        r = segment.iloc[0]
        m, starts = _matrix(r), np.cumsum(r["lengths"]) - r["lengths"]
        ids = [m.access(int(starts[d]) + p) if 0 <= p < n else None for d, p, n in zip(asked["number"], asked["place"], asked["n"], strict=True)]
        return pd.DataFrame({"doc_id": asked["doc_id"], "place": asked["place"], "token_id": pd.array(ids, "Int32")})

    within = asked.select(*[F.col(f"of_{k}").alias(f"in_{k}") for k in keys]).distinct()
    held = shards.select(*keys, "n_tokens", "lengths", "zeros", "planes", "ones").join(within, (F.col("shard") == F.col("in_shard")) & (F.col("segment") == F.col("in_segment")), "left_semi")
    return asked.groupBy("of_shard", "of_segment").cogroup(held.groupBy(*keys)).applyInPandas(run, f"doc_id {id_type}, place long, token_id int")


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone.  Rows of one id are ordered by
    text (equal ones in any order, as they are alike), rows without id come
    first.  A text of any length is one document; other columns are ignored,
    whatever their names.  An empty table gives no row.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "shards")
    write_shards(docs, tokenizer_file, end_id, path)
    shards = spark.read.parquet(path)

    id_type = docs.schema["doc_id"].dataType
    kind = to_arrow_type(id_type)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n, crc = len(r["lengths"]), [zlib.crc32(x) for x in _documents(r)]
            keys = [pa.array([r[k]] * n, pa.int32()) for k in ("shard", "segment")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(r["doc_ids"], kind), pa.array(np.cumsum(r["lengths"]) - r["lengths"]), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(giving_back(checked), f"shard int, segment int, doc_id {id_type.simpleString()}, inside long, n_tokens long, ids_crc32 long")
    # A row a shard, then a row a segment of one shard: no window is over documents.
    sizes = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", "segment", F.coalesce(inside, F.lit(0)).alias("a")).join(sizes.select("shard", F.coalesce(before, F.lit(0)).alias("b")), "shard")
    return rows.join(offsets, ["shard", "segment"]).select("doc_id", (F.col("a") + F.col("b") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
