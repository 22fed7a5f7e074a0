"""Benchmark decontamination by CGK embedding and bit sampling.

Texts are compared as words, lower-case and without punctuation.  A document
holds a benchmark item if a passage of it is within ``rate`` of the item's
words in edit distance (words put in, left out or changed).

1. An edit touches two pairs of neighbouring words, so a passage within ``k``
   edits of an item of ``L`` words has ``L - 1 - 2k`` of the item's own word
   pairs.  Where that is none, ``L - k`` of its words are asked for instead.
   Stretches of a text with fewer of an item's pairs are not walked; this loses
   nothing at any length.
2. An item is cut into windows of 12 to 23 words (one window, if it is shorter).
   At least one of them has no more than its share of the item's edits, so long
   items are found as surely as short ones.
3. The CGK random walk writes a window's words one after another, at each step
   going on to the next word or staying, by a random bit for step and word.  It
   maps windows near in edit distance to strings near in Hamming distance.
4. Each of ``tables`` walks is sampled at ``samples`` places.  A stretch of which
   a window agrees with one of the item's at all of them becomes a candidate.  The
   number of tables of each item length is half as many again as reach ``recall``
   on copies with the most edits allowed (:attr:`Index.tables`).  A length that
   ``most_tables`` don't bring there has every stretch as a candidate.
5. Candidates are verified by the exact edit distance, a word of the text at a
   time for all words of the item together (Myers' bit vectors).
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import giving_back, text_of

_EDGES = re.compile(r"^\W+|\W+$")
_COINS = 256
#: Windows have this many words at least, where the item has.
_WINDOW = 12
#: Copies that the recall of a length is measured on, and the longest length that is measured; with more windows it only grows.
_COPIES, _MEASURED = 300, 120
#: Steps of walks taken together.
_TOGETHER = 1 << 18
_WORDS = 1 << 20
#: Words of texts whose numbers are remembered.
_REMEMBERED = 1 << 19


@dataclass(frozen=True)
class Leaks:
    """rate: edits a word of the item, below 1; recall: share of the copies with the most edits that the walks are to find.

    block_bytes: text of items sent to the tasks at a time; a larger benchmark takes several passes over the documents.
    """

    rate: float = 0.25
    samples: int = 3
    recall: float = 0.995
    most_tables: int = 64
    block_bytes: int = 8_000_000


def plain_words(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; what is all punctuation is no word."""
    return [w for w in (_EDGES.sub("", x) for x in text.lower().split()) if w]


def edit_distance(item: list[int], passage: list[int]) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any part of ``passage``, and that part's start and end."""
    row = [(0, j) for j in range(len(passage) + 1)]
    for i, word in enumerate(item, 1):
        last, row = row, [(i, 0)]
        for j, other in enumerate(passage, 1):
            d, s = last[j - 1]
            best = (d + (word != other), s)
            if last[j][0] + 1 < best[0]:
                best = (last[j][0] + 1, last[j][1])
            if row[-1][0] + 1 < best[0]:
                best = (row[-1][0] + 1, row[-1][1])
            row.append(best)
    d, end = min((d, j) for j, (d, _) in enumerate(row))
    return d, row[end][1], end


def nearest_end(item: list[int], passage: list[int]) -> tuple[int, int]:
    """The distance of :func:`edit_distance` and the end of its part, by bit vectors over the item's words."""
    at: dict[int, int] = {}
    for i, word in enumerate(item):
        at[word] = at.get(word, 0) | 1 << i
    mask, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, now = mask, 0, len(item)
    best, end = now, 0
    for j, word in enumerate(passage, 1):
        same = at.get(word, 0)
        v, h = same | down, (((same & up) + up) ^ up) | same
        more, less = (down | ~(h | up)) & mask, up & h
        if more & high:
            now += 1
        elif less & high:
            now -= 1
            if now < best:
                best, end = now, j
        more, less = more << 1, less << 1
        up, down = (less | ~(v | more)) & mask, more & v & mask
    return best, end


class _Numbers(dict):
    """What stands between white space -> its word's number; 0 for a word of no item, -1 for what is no word."""

    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, raw: str) -> int:
        word = _EDGES.sub("", raw)
        number = self.words.get(word, 0) if word else -1
        if len(self) < _REMEMBERED:
            self[raw] = number
        return number


class Index:
    """The benchmark's words, and which items hold a word pair."""

    def __init__(self, items: list[tuple[object, str]], setup: Leaks):
        if not 0 <= setup.rate < 1:
            raise ValueError("rate must be from 0 to below 1")
        self.setup = setup
        self.words: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in plain_words(text)]
            if ids:
                self.items.append((name, np.array(ids, np.int64)))
        self.n = len(self.words) + 1
        self.sizes: dict[int, list[int]] = {}
        for i, (_, x) in enumerate(self.items):
            self.sizes.setdefault(len(x), []).append(i)
        #: Pairs of an item, or words where that says nothing, that a passage within its edits has at least.
        by_pairs = [len(x) - 1 - 2 * self.edits(len(x)) for _, x in self.items]
        self.need = np.array([p if p > 0 else len(x) - self.edits(len(x)) for p, (_, x) in zip(by_pairs, self.items)], np.int64)
        #: How far the last word of a passage may be from its first.
        self.reach = np.array([len(x) + self.edits(len(x)) - 1 for _, x in self.items], np.int64)
        self.single = any(p <= 0 for p in by_pairs)
        # A word's own number stands for it among the pairs, whose first word is 1 or more.
        grams = [np.unique(x[:-1] * self.n + x[1:] if p > 0 else x) for p, (_, x) in zip(by_pairs, self.items)]
        gram, holder = np.concatenate([*grams, np.empty(0, np.int64)]), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(gram, kind="stable")
        self.holders = holder[order]
        self.grams, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(gram))

        rng = np.random.default_rng(1)
        #: [table, step, word mod _COINS]: whether the walk goes on.
        self.coins = rng.integers(0, 2, (setup.most_tables, 2 * _WINDOW, _COINS), np.int8)
        shares = rng.random((setup.most_tables, setup.samples))
        #: [table, sample] for each size of windows: the steps that are sampled.
        self.places = {m: np.sort((shares * 2 * min(m, _WINDOW)).astype(int), 1) for m in range(1, 2 * _WINDOW)}
        #: Tables taken, for each length of items; 0 where each stretch is a candidate.
        self.tables = {size: self._tables(size) for size in sorted(self.sizes)}
        self.keys = self._keys()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}

    @functools.cached_property
    def numbers(self) -> _Numbers:
        return _Numbers(self.words)

    def edits(self, length: int) -> int:
        return int(self.setup.rate * length)

    def window(self, length: int) -> int:
        """Words in each of the windows that an item is cut into."""
        return length // max(1, length // _WINDOW)

    def walk(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, tables: range) -> np.ndarray:
        """[window, table]: the sampled embedding of each window and the item that it is compared with, as one number."""
        t, at = np.array(tables), np.repeat(starts[:, None], len(tables), 1)
        ends, padded = (starts + sizes)[:, None], np.append(ids, -1)
        written = np.empty((2 * _WINDOW, *at.shape), np.int64)
        for step in range(2 * _WINDOW):
            word = np.where(at < ends, padded[np.minimum(at, len(ids))], -1)
            written[step] = word
            at = at + self.coins[t, step, word % _COINS]
        places = np.zeros((2 * _WINDOW, len(t), self.setup.samples), int)
        for m in np.unique(sizes).tolist():
            places[m] = self.places[m][t]
        key = np.repeat(owners.astype(np.uint64)[:, None], len(t), 1)
        row, column = np.arange(len(starts))[:, None], np.arange(len(t))
        for k in range(self.setup.samples):
            key = (key + written[places[sizes, :, k], row, column].astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        return key

    def _cut(self, length: int, start: int) -> np.ndarray:
        m = self.window(length)
        return start + np.arange(length // m) * m

    def _keys(self) -> list[np.ndarray]:
        """For each table the sorted embeddings of the windows of all items that take it."""
        flat = np.concatenate([*(x for _, x in self.items), np.empty(0, np.int64)])
        fronts = np.cumsum([0] + [len(x) for _, x in self.items])
        parts: list[list] = [[] for _ in range(self.setup.most_tables)]
        own = [i for i, (_, x) in enumerate(self.items) if self.tables[len(x)]]
        for some in (own[k : k + 256] for k in range(0, len(own), 256)):
            cuts = [self._cut(len(self.items[i][1]), fronts[i]) for i in some]
            owners = np.repeat(some, [len(c) for c in cuts])
            sizes = np.array([self.window(len(self.items[i][1])) for i in owners.tolist()])
            most = np.array([self.tables[len(self.items[i][1])] for i in owners.tolist()])
            keys = self.walk(flat, np.concatenate(cuts), sizes, owners, range(most.max()))
            for t in range(most.max()):
                parts[t].append(keys[most > t, t])
        return [np.unique(np.concatenate(p)) if p else np.empty(0, np.uint64) for p in parts]

    def _tables(self, size: int) -> int:
        """Walks needed for the recall aimed at, on copies with the most edits allowed; 0 if ``most_tables`` are too few."""
        if size > _MEASURED:
            return self._tables(_MEASURED)
        rng, k, m = np.random.default_rng(size), self.edits(size), self.window(size)
        source = rng.integers(1, 1 << 40, (_COPIES, size))
        copies = []
        for x in source.tolist():
            for _ in range(k):
                spot, kind = int(rng.integers(0, len(x) + 1)), rng.integers(0, 3)
                if kind == 0:
                    x.insert(spot, int(rng.integers(1, 1 << 40)))
                elif kind == 1 and len(x) > 1:
                    x.pop(min(spot, len(x) - 1))
                else:
                    x[min(spot, len(x) - 1)] = 0
            copies.append((x + [0] * (2 * size))[: 2 * size])
        missed, cuts = np.ones(_COPIES, bool), self._cut(size, 0)
        flat, ids = source.ravel(), np.array(copies).ravel()
        for t in range(self.setup.most_tables):
            left = np.flatnonzero(missed)
            own, starts = (left[:, None] * size + cuts).ravel(), (left[:, None] * 2 * size + np.arange(size + k)).ravel()
            sizes = np.full(len(starts), m)
            known = self.walk(flat, own, sizes[: len(own)], np.repeat(left, len(cuts)), range(t, t + 1))
            found = np.isin(self.walk(ids, starts, sizes, np.repeat(left, size + k), range(t, t + 1)), known)
            missed[left] = ~found.reshape(len(left), -1).any(1)
            if missed.mean() <= 1 - self.setup.recall:
                # The copies tell the recall to about a hundredth: half as many again make sure of it.
                return min((t + 1) * 3 // 2 + 1, self.setup.most_tables)
        return 0

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        return self.search_all([text])[0]

    def search_all(self, texts: list[str]) -> list[list[tuple[object, int, int, int]]]:
        """For each text (item, distance, first word, words) of the nearest passage for each item that it holds.

        The words of many texts are looked up together; no passage goes on into the next text.
        """
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        held, size = [], 0

        def flush() -> None:
            for (n, _), found in zip(held, self._search([ids for _, ids in held]) if held else [], strict=True):
                out[n] = [(self.items[i][0], *x) for i, x in sorted(found.items())]

        for n, text in enumerate(texts):
            ids = np.fromiter(map(self.numbers.__getitem__, text.lower().split()), np.int64)
            ids = ids[ids >= 0]
            if np.count_nonzero(ids) >= self.need.min():
                held.append((n, ids))
                size += len(ids)
            if size >= _WORDS:
                flush()
                held, size = [], 0
        flush()
        return out

    def _search(self, held: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """The nearest passages of some texts, given as word numbers."""
        gap = np.zeros(int(self.reach.max()) + 1, np.int64)
        every = np.concatenate([x for ids in held for x in (ids, gap)])
        fronts = np.cumsum([0] + [len(ids) + len(gap) for ids in held])
        gram, at = np.where((every[:-1] > 0) & (every[1:] > 0), every[:-1] * self.n + every[1:], 0), np.arange(len(every) - 1)
        if self.single:
            gram, at = np.concatenate([gram, every]), np.concatenate([at, np.arange(len(every))])
        row = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = (self.grams[row] == gram) & (gram > 0)
        row, at = row[known], at[known]
        # Where a passage is, no fewer grams of all items together stand around than any item needs.
        places = np.sort(at)
        around = np.searchsorted(places, at + self.reach.max(), "right") - np.searchsorted(places, at - self.reach.max(), "left")
        row, at = row[around >= self.need.min()], at[around >= self.need.min()]
        # A row for each gram and each of its items, by item and place.
        times = self.first[row + 1] - self.first[row]
        item = self.holders[np.repeat(self.first[row] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        key = np.sort(item * len(every) + np.repeat(at, times))
        item, at = np.divmod(key, len(every))
        last = np.arange(len(key)) + self.need[item] - 1
        end = key[np.minimum(last, len(key) - 1)] if len(key) else key
        full = (last < len(key)) & (end - key <= self.reach[item])
        item, at, end = item[full], at[full], at[full] + (end - key)[full]
        text = np.searchsorted(fronts, at, "right") - 1
        low, high = np.maximum(end - self.reach[item], fronts[text]), np.minimum(at + self.reach[item] + 1, fronts[text + 1] - len(gap))
        # Stretches that meet are one.
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        heads = np.flatnonzero(new)
        item, text, low, high = item[heads], text[heads], low[heads], high[np.append(heads[1:], len(high)) - 1] if len(heads) else heads
        found: list[dict] = [{} for _ in held]
        for at in np.flatnonzero(self._candidates(every, item, low, high)).tolist():
            i, d, a, b = int(item[at]), int(text[at]), int(low[at]), int(high[at])
            self._verify(held[d], a - int(fronts[d]), b - int(fronts[d]), i, found[d])
        return found

    def _candidates(self, every: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which stretches have a window whose sampled walk is one of the item's."""
        sizes = np.array([len(x) for _, x in self.items])
        most = np.array([self.tables[n] for n in sizes.tolist()])[item]
        hit, window = most == 0, np.array([self.window(n) for n in sizes.tolist()])[item]
        # A few tables find most; only what they leave takes the rest.
        for tables in (range(0, 4), range(4, 16), range(16, self.setup.most_tables)):
            open_ = np.flatnonzero(~hit & (most > tables.start))
            if not len(open_) or not len(tables):
                continue
            tables = range(tables.start, min(tables.stop, int(most[open_].max())))
            spans = (high - low)[open_]
            ends = np.cumsum(spans)
            for part in np.split(open_, np.searchsorted(ends, np.arange(1, ends[-1] * len(tables) // _TOGETHER + 1) * (_TOGETHER // len(tables)))):
                if not len(part):
                    continue
                n = (high - low)[part]
                of = np.repeat(part, n)
                starts = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keys = self.walk(every, starts, window[of], item[of], tables)
                for column, t in enumerate(tables):
                    known = self.keys[t]
                    if len(known):
                        same = known[np.minimum(np.searchsorted(known, keys[:, column]), len(known) - 1)] == keys[:, column]
                        hit[of[same & (most[of] > t)]] = True
        return hit

    def _verify(self, ids: np.ndarray, low: int, high: int, i: int, found: dict) -> None:
        if i in found and found[i][0] == 0:
            return
        item, passage = self.items[i][1], ids[low:high]
        k = self.edits(len(item))
        # A bound from below by the words in common spares most of the exact distances.
        if np.isin(item, passage).sum() < len(item) - k:
            return
        d, end = nearest_end(item.tolist(), passage.tolist())
        if d > k or i in found and d >= found[i][0]:
            return
        front = max(end - len(item) - k, 0)
        start = end - len(item) if d == 0 else front + edit_distance(item.tolist(), passage[front:end].tolist())[1]
        found[i] = d, low + start, end - start


def find_leaks(docs: DataFrame, benchmark: DataFrame, setup: Leaks = Leaks()) -> DataFrame:
    """Rows (doc_id, item_id, distance, first_word, n_words): each item that a document holds, at its nearest passage.

    Null and empty texts hold nothing, and an item without a word is in no
    document; texts of any length are searched whole.  Rows of one id are
    searched one by one, so a repeated row repeats its finds; items of one id
    are one item if their texts are equal.  Of passages at one distance the first
    counts.  Ids may be of any type; no other column of either table is read or
    returned, whatever its name.  An empty table on either side gives no row.
    """
    spark, id_type, item_type = docs.sparkSession, docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    items = benchmark.select("item_id", text_of().alias("text")).distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / setup.block_bytes))
    names = ["doc_id", "item_id", "distance", "first_word", "n_words"]
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, distance int, first_word long, n_words long"
    types = [to_arrow_type(id_type), to_arrow_type(item_type), pa.int32(), pa.int64(), pa.int64()]
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in own.collect()], setup))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = index.search_all(batch.column("text").to_pylist())
                rows = [(name, *x) for name, own in zip(batch.column("doc_id").to_pylist(), found, strict=True) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        found = docs.select("doc_id", text_of().alias("text")).mapInArrow(giving_back(search), schema)
        out = found if out is None else out.union(found)
    return out
