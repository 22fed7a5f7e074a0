"""Removal of byte strings that occur twice, by an enhanced suffix array.

Every string of ``length`` bytes (a window) has an anchor: of its strings of
GRAM bytes the one with the least hash, the leftmost on a tie.  Equal windows
have equal anchors at equal places, so only anchors that occur twice can hold
repeated windows, and two windows need comparing only within one anchor's
occurrences.  The windows of one anchor lie side by side; the bytes that they
cover are its context.

1. Anchors are counted over all documents, combined before the shuffle.
2. Occurrences with one common context are repeated wholly.  Of the others
   each distinct context is kept once, with its count.
3. For each anchor the suffixes of its distinct contexts are sorted; a stack
   scan over the common prefixes of neighbours gives the tree of common-prefix
   intervals.  An interval of at least ``length`` bytes with several
   occurrences is a repeat, and it is maximal if its suffixes differ in the
   byte to their left.  Each maximal repeat covers all of its occurrences.
4. An anchor with more than ``most_contexts`` contexts isn't gathered in one
   task.  Its windows are halved instead, by how far left of the anchor they
   start: a block of windows is repeated wholly if all its bytes are, and holds
   no repeat if the bytes that its windows share are unlike all others.  Of the
   rest, blocks that share the same bytes go to the tree as soon as they are
   ``most_contexts`` at most; only more of them are halved again.  The counts are
   combined before the shuffle.  A context gives three blocks at first and two
   for each that is halved, so rows grow with contexts, however they are grouped.

Contexts and windows are told apart by 64-bit hashes besides the 64-bit hash
of their anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, giving_back, runs_of_bytes, staged, text_of

GRAM = 32
_PIECE = 1 << 20
_PLACE = 21  # bits for a place within a piece and what it overlaps


@dataclass(frozen=True)
class Anchors:
    """place of the anchor, first and last window start that it owns, hash of its bytes; sorted by place."""

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of GRAM bytes."""
    x = raw.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    h = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ x[k : k + len(h)]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def find_anchors(raw: bytes, length: int) -> Anchors:
    """All anchors of a text; long texts are taken in pieces that overlap by a window."""
    parts: list[tuple] = []
    for at in range(0, max(len(raw) - length + 1, 0), _PIECE):
        piece = np.frombuffer(raw, np.uint8, min(_PIECE + length - 1, len(raw) - at), at)
        grams = _gram_hashes(piece)
        least = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, width = length - GRAM + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        owner = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        parts.append((owner[new] + at, new + at, np.append(new[1:], len(owner)) - 1 + at, grams[owner[new]].view(np.int64)))
    if not parts:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none)
    return Anchors(*map(np.concatenate, zip(*parts, strict=True)))


def _context(raw: memoryview | bytes, place: int, first: int, last: int, length: int) -> int:
    """A signed 64-bit hash of the context's bytes and of the anchor's place in it."""
    return xxhash.xxh3_64_intdigest(raw[first : last + length], place - first) - (1 << 63)


def maximal_repeats(contexts: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context the maximal repeats of at least ``length`` bytes that it takes part in, as (start, end).

    ``counts``: occurrences of each context.
    """
    suffixes = sorted((text[i:], k, i) for k, text in enumerate(contexts) for i in range(len(text) - length + 1))
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    before = [contexts[k][i - 1] if i else -1 - n for n, (_, k, i) in enumerate(suffixes)]
    changes = np.cumsum([0] + [a != b for a, b in zip(before, before[1:])])

    def report(low: int, high: int, depth: int) -> None:
        """An interval of the tree: suffixes low to high share depth bytes."""
        if changes[high] > changes[low] or before[low] < 0:
            for _, k, i in suffixes[low : high + 1]:
                found[k].append((i, i + depth))

    for n, (text, k, _) in enumerate(suffixes):
        if counts[k] > 1:  # a leaf that stands for several equal suffixes
            report(n, n, len(text))
    stack: list[tuple[int, int]] = []  # depth and first suffix of the open intervals
    for n in range(1, len(suffixes) + 1):
        common = _common_prefix(suffixes[n - 1][0], suffixes[n][0], length) if n < len(suffixes) else 0
        low = n - 1
        while stack and stack[-1][0] > common:
            depth, low = stack.pop()
            report(low, n - 1, depth)
        if common >= length and (not stack or stack[-1][0] < common):
            stack.append((common, low))
    return found


def _common_prefix(a: bytes, b: bytes, least: int) -> int:
    """Length of the common prefix, 0 if under ``least``."""
    if a[:least] != b[:least]:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = least, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as maximal ranges in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeated_ranges(docs: DataFrame, length: int, most_contexts: int) -> DataFrame:
    """Rows (doc_id, _h, start, end) whose union is what is repeated; ``docs``: doc_id, _h, text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for lo, hi in runs_of_bytes(texts, 1 << 22):
                rows, hashes, parts = [], [], []
                for i in range(lo, hi):
                    a, view = find_anchors(texts[i], length), memoryview(texts[i])
                    rows.append(np.full(len(a.place), i))
                    parts.append(a)
                    hashes += [_context(view, *x, length) for x in zip(a.place.tolist(), a.first.tolist(), a.last.tolist(), strict=True)]
                at = pa.array(np.concatenate(rows))
                columns = {"gram": np.concatenate([a.gram for a in parts]), "context": np.array(hashes, np.int64)}
                columns |= {"place": np.concatenate([a.place for a in parts]), "first": np.concatenate([a.first for a in parts]), "last": np.concatenate([a.last for a in parts])}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()} | {"doc_id": batch.column("doc_id").take(at), "_h": batch.column("_h").take(at)})

    long = docs.where(F.octet_length("text") >= length)
    schema = "gram long, context long, place long, first long, last long"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = long.mapInArrow(giving_back(anchors), f"{schema}, doc_id {id_type}, _h long")
    several = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    several = several.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed"))
    repeated = staged(found.join(several, "gram"), "repeated")
    where = F.struct("doc_id", "_h", "place", "first", "last")
    occurrences = repeated.groupBy("gram", "context", "mixed").agg(F.count("*").alias("n"), F.min(where).alias("at"))
    distinct = occurrences.where("mixed").select("gram", "context", "n", "at.*")
    crowd = distinct.groupBy("gram").agg((F.count("*") > most_contexts).alias("crowded"))
    distinct = distinct.join(crowd, "gram")
    wanted = distinct.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("gram", "context", "n", "place", "first", "last", "crowded")).alias("wanted"))
    same = [docs["doc_id"].eqNullSafe(wanted["doc_id"]), docs["_h"] == wanted["_h"]]
    wanted = docs.join(wanted, same).select("text", "wanted")
    cut = F.expr(f"transform(wanted, x -> named_struct('gram', x.gram, 'context', x.context, 'n', x.n, 'crowded', x.crowded, 'place', x.place - x.first, 'bytes', substring(cast(text as binary), cast(x.first + 1 as int), cast(x.last - x.first + {length} as int))))")
    contexts = staged(wanted.select(F.explode(cut).alias("x")).select("x.*"), "contexts")
    none = [F.lit(0).cast("long").alias(c) for c in ("size", "block", "shared", "base")]
    tree, found = contexts.where("not crowded").select("gram", *none, "context", "n", "bytes"), None
    crowded = contexts.where("crowded").select("gram", "context", "n", "place", "bytes")
    if not crowded.isEmpty():
        found, few = _halved(crowded, length, most_contexts)
        tree = tree.unionByName(few)
    tree = tree.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "context")
    ranges = tree.mapInArrow(giving_back(_tree_ranges(length)), "gram long, context long, start long, end long")
    if found is not None:
        ranges = ranges.union(found)
    ranges = ranges.groupBy("gram", "context").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    partly = repeated.where("mixed").join(ranges, ["gram", "context"]).select("doc_id", "_h", "first", F.explode("ranges").alias("r"))
    wholly = repeated.where("not mixed").select("doc_id", "_h", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    return wholly.union(partly.select("doc_id", "_h", F.col("first") + F.col("r.start"), F.col("first") + F.col("r.end")))


#: What is gathered for one tree: an anchor's contexts, or its blocks of one size and place that share the same bytes.
_GROUP = ["gram", "size", "block", "shared"]


def _tree_ranges(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close() -> list[tuple]:
            unique = list({x[0]: x for x in group}.values())
            found = maximal_repeats([x[2] for x in unique], [x[1] for x in unique], length)
            return [(key[0], x[0], x[3] + a, x[3] + b) for x, ranges in zip(unique, found, strict=True) for a, b in merged(ranges)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["gram", "context", "start", "end"])

        rows: list[tuple] = []
        for batch in batches:
            for *own, context, n, text, base in zip(*(batch.column(c).to_pylist() for c in (*_GROUP, "context", "n", "bytes", "base")), strict=True):
                if own != key and group:
                    rows += close()
                    group = []
                key = own
                group.append((context, n, text, base))
            yield batch_of(rows)
            rows = []
        if group:
            yield batch_of(close())

    return scan


def _halved(contexts: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """What is wholly repeated (gram, context, start, end) in contexts of which any number may have one anchor, and groups of at most ``most`` blocks for the tree."""
    size = 1 << (length - GRAM).bit_length() - 2
    kind = "gram long, context long, n long, place long, bytes binary, block long, low long, high long, all long, shared long"
    open_blocks, out, few = contexts.withColumn("block", F.lit(None).cast("long")), None, None
    while size:
        blocks = staged(open_blocks.mapInArrow(giving_back(_blocks(size, length)), kind), "blocks")
        whole = blocks.groupBy("gram", "low", "high", "all").agg(F.sum("n").alias("same"), F.min("context").alias("keeper")).where("same > 1")
        known = blocks.join(whole, ["gram", "low", "high", "all"], "left")
        found = known.where("same > 1").select("gram", "context", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))
        out = found if out is None else out.union(found)
        # Of equal blocks one goes on for all, as others may equal a part of it.
        going = known.where("same is null or context = keeper").withColumn("n", F.coalesce("same", "n"))
        alike = going.groupBy("gram", "block", "shared").agg(F.count("*").alias("alike")).where("alike > 1")
        going = staged(going.join(alike, ["gram", "block", "shared"]), "going")
        own = F.substring("bytes", F.expr("cast(place - high + 1 as int)"), F.expr(f"cast(high - low + {length} as int)")).alias("bytes")
        ready = going.where(F.col("alike") <= most).select("gram", F.lit(size).cast("long").alias("size"), "block", "shared", (F.col("place") - F.col("high")).alias("base"), "context", "n", own)
        few = ready if few is None else few.union(ready)
        open_blocks = going.where(F.col("alike") > most).select("gram", "context", "n", "place", "bytes", "block")
        size //= 2
    return out, few


def _blocks(size: int, length: int):
    """Cut each context's windows (those of ``block`` at twice the size, or all) into blocks of ``size``.

    Windows are told by how many bytes left of the anchor they start.  low and
    high: the context's own windows in the block; all: hash of the bytes they
    cover; shared: hash of the bytes that all windows of the block would share.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, place = r["bytes"], r["place"]
                least, most = place - (len(text) - length), place
                own = range(least // size, most // size + 1) if r["block"] is None else (2 * r["block"], 2 * r["block"] + 1)
                for block in own:
                    low, high = max(least, block * size), min(most, block * size + size - 1)
                    if low <= high:
                        shared = text[place - block * size : place - (block * size + size - 1) + length]
                        rows.append(r | {"block": block, "low": low, "high": high, "all": digest(text[place - high : place - low + length]), "shared": digest(shared)})
            names = ["gram", "context", "n", "place", "bytes", "block", "low", "high", "all", "shared"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == "bytes" else pa.int64()) for k in names], names)

    return cut


def remove_repeats(docs: DataFrame, length: int = 200, most_contexts: int = 256, whole_characters: bool = False) -> DataFrame:
    """All columns of ``docs``, ``spans`` (maximal removed ranges of bytes) and ``kept`` (the other bytes).

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else in the texts, judged on the input.  With
    ``whole_characters`` a character goes only if all its bytes do, so ``kept``
    stays UTF-8.  A null text counts as empty; texts under ``length`` bytes are
    kept.  Rows with equal id and text repeat each other and get equal results.
    Columns named like a result, or ``_h``, are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "spans", "kept", "_h")]
    frame = docs.select(*rest, text_of().alias("text"), F.xxhash64(text_of()).alias("_h"))
    ranges = repeated_ranges(frame.select("doc_id", "_h", "text"), length, most_contexts)
    ranges = ranges.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    same = [frame["doc_id"].eqNullSafe(ranges["doc_id"]), frame["_h"] == ranges["_h"]]
    both = frame.join(ranges, same, "left").select(*[frame[c] for c in rest], frame["text"], F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, starts, ends in zip(byte_texts(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                own = merged(list(zip(starts or [], ends or [], strict=True)))
                if whole_characters:
                    own = [x for x in (_inward(text, a, b) for a, b in own) if x[0] < x[1]]
                spans.append([{"start": a, "end": b} for a, b in own])
                edges = [0, *(x for span in own for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            ranges = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column("text"), ranges, pa.array(kept, pa.binary())], [*rest, "text", "spans", "kept"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*rest, "text").schema)
    return both.mapInArrow(giving_back(cut), f"{columns}, spans array<struct<start: long, end: long>>, kept binary")


def _inward(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The range without parts of characters at its ends."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end
