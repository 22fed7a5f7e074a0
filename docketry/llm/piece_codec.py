"""SentencePiece encoding by streaming Viterbi, and decoding.

Every piece of the vocabulary has a score; an encoding is the cover of the text
with the highest sum.  Two paths can only meet at a position less than the
longest piece back, so the search keeps that many states, and whenever the
paths of all of them pass one boundary, the ids before it are committed and
forgotten.  Memory is bounded by the piece length and not by the text.

A text becomes pieces as is usual for such vocabularies: one space is put in
front, and spaces are written as U+2581.  No piece continues past a space mark
or holds a new line, so these places are boundaries of every path; what lies
between two of them is remembered with its ids, in a cache of bounded size.
A character that no piece has is spelled in byte pieces, and so is a U+2581
that stands in the text, so decoding gives back every text exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

SPACE = "▁"
_CACHED, _LONGEST_CACHED = 400_000, 64


class Codec:
    """Pieces and scores of a sentencepiece model file with byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.raw.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.piece[name] = (i, model.get_score(i))
                self.raw.append(name.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.piece))
        self.trie: dict = {}
        for name, found in self.piece.items():
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = found
        #: Below every cover by pieces that could replace a spelled character.
        self.spelled = min(s for _, s in self.piece.values()) * 2 - 1
        self.free = all(SPACE not in name.lstrip(SPACE) for name in self.piece) and not any("\n" in name for name in self.piece)
        self.inner, self.after_space = _Memo(self, ""), _Memo(self, SPACE)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a marked text in committed portions.

        On a tie the longer last piece wins.  Kept are the positions since the
        last commit, and the pieces that start there and reach ahead.
        """
        spelled, root, patience = self.spelled, self.trie, 2 * self.longest
        base = 0  # the last committed boundary; lists hold the positions from it on
        score, back, ids = [0.0], [0], [None]
        for start in range(len(text)):
            at = start - base
            here = score[at]
            if len(score) == at + 1:
                score.append(None), back.append(0), ids.append(None)
            if score[at + 1] is None or here + spelled > score[at + 1]:
                score[at + 1], back[at + 1], ids[at + 1] = here + spelled, at, text[start]
            node, end = root, at
            for c in text[start : start + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                if end == len(score):
                    score.append(None), back.append(0), ids.append(None)
                found = node.get("")
                if found and (score[end] is None or here + found[1] > score[end]):
                    score[end], back[end], ids[end] = here + found[1], at, found[0]
            if at + 1 >= patience:
                meet = self._meeting(back, at + 1)
                if meet:
                    yield self._path(back, ids, meet)
                    base += meet
                    del score[:meet], back[:meet], ids[:meet]
                    back = [max(x - meet, 0) for x in back]
                else:
                    patience += self.longest
                    continue
                patience = 2 * self.longest
        yield self._path(back, ids, len(text) - base)

    def _meeting(self, back: list[int], end: int) -> int:
        """The last boundary on the paths of all positions that a later piece can start from; 0 if there is none."""
        live = set(range(max(end - self.longest + 1, 0), end + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(back[last])
        return live.pop()

    def _path(self, back: list[int], ids: list, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(ids[end])
            end = back[end]
        return [i for part in reversed(out) for i in ([part] if isinstance(part, int) else [self.byte[b] for b in part.encode("utf-8", "replace")])]

    def _plain(self, text: str) -> bytes:
        """Any text, its mark of the front included, without cuts."""
        # A mark that stands in the text itself is spelled.
        out: list[int] = []
        parts = text.split(SPACE)
        for k, part in enumerate(parts):
            if k:
                out += [self.byte[b] for b in SPACE.encode()]
            for ids in self.stream(part.replace(" ", SPACE)):
                out += ids
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if SPACE in text or not self.free:
            return self._plain(" " + text)
        new_line = np.array([self.byte[10]], "<u4").tobytes()
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(new_line)
            words = line.split(" ")
            if "" in words and (line or not n):
                out.append(self._plain(" " * (not n) + line))
            elif line:
                out.append((self.inner if n else self.after_space)[words[0]])
                out += map(self.after_space.__getitem__, words[1:])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text[1:].decode("utf-8", "replace")


class _Memo(dict):
    """Part of a text between two certain boundaries -> its ids."""

    def __init__(self, codec: Codec, front: str):
        super().__init__()
        self.codec, self.front = codec, front

    def __missing__(self, part: str) -> bytes:
        ids = np.array([i for some in self.codec.stream(self.front + part) for i in some], "<u4").tobytes()
        if len(part) <= _LONGEST_CACHED:
            if len(self) >= _CACHED:
                self.clear()
            self[part] = ids
        return ids


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """All columns of ``docs`` but text, then ``ids`` (little-endian unsigned 32-bit
    integers), ``n_ids``, ``ids_crc32`` and ``restored``: whether the decoded ids
    are the text again.

    ``model_file``: a path that every executor has.  A null or empty text has no
    ids and counts as restored.  Rows are independent: repeated rows give equal results.
    """
    names = ("ids", "n_ids", "ids_crc32", "restored")
    rest = [c for c in docs.columns if c != "text" and c not in names]
    frame = docs.select(*rest, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = frame.drop("text").schema.add("ids", "binary").add("n_ids", "long").add("ids_crc32", "long").add("restored", "boolean")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [codec.encode(x) for x in texts]
            same = [codec.decode(i) == x for i, x in zip(ids, texts, strict=True)]
            columns = [*(batch.column(c) for c in rest), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *names])

    return frame.mapInArrow(giving_back(encode), schema)
