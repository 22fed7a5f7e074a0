"""Similarities of short texts that Spark has no function for, as Arrow functions.

Each works on two columns in batches.  A ratio is 100 times twice the longest
common subsequence over both lengths (insertions and deletions only); Spark's
``levenshtein`` is another measure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole-number bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


class Subsequence:
    """A text that many others are held against: its letters' places are noted once."""

    def __init__(self, text: str):
        self.text, self.masks = text, {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def common(self, other: str) -> int:
        full = rest = (1 << len(self.text)) - 1
        for mask in map(self.masks.get, other):
            if mask is not None:
                hit = rest & mask
                if hit:
                    rest = (rest + hit | rest - hit) & full
        return len(self.text) - rest.bit_count()

    def ratio(self, other: str) -> float:
        if self.text == other:
            return 100.0
        return 100.0 * 2 * self.common(other) / (len(self.text) + len(other))


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """Of the words of both: 100 if one side's are all in the other's, else the best ratio of the shared and the whole."""
    apart = _words_apart(a, b)
    return apart if isinstance(apart, float) else _best_of_words(*apart, ratio(apart[1], apart[2]))


def _best_of_words(both: str, one: str, two: str, whole: float) -> float:
    """The shared words begin either side, so all their letters are in common with it."""
    return max(whole, *(100.0 * 2 * len(both) / (len(both) + len(x)) for x in (one, two))) if both else whole


def _words_apart(a: str, b: str) -> float | tuple[str, str, str]:
    """The token-set ratio where no letters need be compared, else the shared words and the whole of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    return both, f"{both} {left}".strip(), f"{both} {right}".strip()


class TokenSet:
    """A text that many others are held against by :func:`token_set`: its words and its letters' places are noted once.

    Words that both have begin either side and count whole, so only the letters
    of the other words are compared: those of shared words are masked out.
    """

    def __init__(self, text: str):
        self.text, self.words, self.places, self.masks = text, set(text.split()), {}, {}
        at = 0
        for word in sorted(self.words):
            # With the blank behind it, which the last one hasn't.
            self.places[word] = ((1 << len(word) + 1) - 1) << at
            at += len(word) + 1
        self.joined = " ".join(sorted(self.words))
        for i, c in enumerate(self.joined):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def ratio(self, other: str, words: set[str]) -> float:
        """The token-set ratio to ``other``, which has these ``words``."""
        if not self.words or not words:
            return 0.0
        if len(other) > 4 * len(self.text):
            return token_set(self.text, other)
        shared = self.words & words
        if shared and (len(shared) == len(self.words) or len(shared) == len(words)):
            return 100.0
        both, right = " ".join(sorted(shared)), " ".join(sorted(words - shared))
        size, masks = len(self.joined), self.masks
        if shared:
            gone = 0
            for word in shared:
                gone |= self.places[word]
            if gone >> size:
                # The last word goes, and with it the blank before it: that of the last word that stays.
                last = max(self.words - shared)
                gone |= 1 << self.places[last].bit_length() - 1
            masks = {c: mask & ~gone for c in set(right) if (mask := self.masks.get(c))}
            size -= sum(map(len, shared)) + len(shared)
        full = rest = (1 << len(self.joined)) - 1
        for mask in map(masks.get, right):
            if mask:
                hit = rest & mask
                if hit:
                    rest = (rest + hit | rest - hit) & full
        common, ahead = len(self.joined) - rest.bit_count(), len(both) + 1 if both else 0
        one, two = ahead + size, ahead + len(right)
        whole = 100.0 * 2 * (ahead + common) / (one + two)
        return max(whole, *(100.0 * 2 * len(both) / (len(both) + n) for n in (one, two))) if both else whole


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _triples(codes: np.ndarray) -> np.ndarray:
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def _flags(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the ``known`` (sorted, each once) are wanted: as isin, without sorting them again."""
    out = np.zeros(len(known), bool)
    if len(known):
        at = np.searchsorted(known, wanted).clip(max=len(known) - 1)
        out[at[known[at] == wanted]] = True
    return out


class Searched:
    """A text in which parts like others are looked for: its letters and triples of letters are numbered once."""

    def __init__(self, text: str):
        self.text, codes = text, _codes(text)
        self.letters, self.letter_at = np.unique(codes, return_inverse=True)
        self.triples, self.triple_at = np.unique(_triples(codes), return_inverse=True) if len(codes) > 2 else (codes[:0], codes[:0])
        self.fours, self.four_at = np.unique(_fours(codes), return_inverse=True) if len(codes) > 3 else (codes[:0], codes[:0])

    def windows(self, short: str, least: float) -> list[tuple[int, int]]:
        """The parts that can be ``least`` like ``short``, in order: none longer, shorter ones only at the ends.

        A part of length w that is t percent like a text of length n has at least
        t (n + w) / 200 letters of it in order, so (t / 40 - 2) (n + w) - 2 of its
        triples of letters: taking a letter out breaks three of them, putting one
        in two.  Parts with fewer positions whose triple the text has anywhere
        can't be.
        """
        n, size, own = len(short), len(self.text), _codes(short)
        share, more, have, fours = least / 40 - 2, 7 * least / 200 - 3, None, None
        if more > 0 and n > 3 and size > 3:
            # The same with fours of letters, which rule out most.
            fours = np.concatenate([[0], np.cumsum(_flags(self.fours, _fours(own))[self.four_at])])
            if fours[-1] < more * n * 200 / (200 - least) - 3 - 1e-9:
                return []
        if share > 0 and n > 2 and size > 2:
            have = np.concatenate([[0], np.cumsum(_flags(self.triples, _triples(own))[self.triple_at])])
            # A part is at least so long as its letters in common.
            if have[-1] < share * n * 200 / (200 - least) - 2 - 1e-9:
                return []
        starts = np.arange(1 - n, size)
        low, high = np.maximum(starts, 0), np.minimum(starts + n, size)
        if fours is not None:
            count = fours[np.maximum(high - 3, low).clip(0, size - 3)] - fours[low.clip(0, size - 3)]
            some = np.flatnonzero(count >= more * (n + high - low) - 3 - 1e-9)
            if not len(some):
                return []
            low, high = low[some], high[some]
        fit = 200 * np.minimum(n, high - low) >= least * (n + high - low)
        letters = _flags(self.letters, own)[self.letter_at]
        # A part that ends in a letter the shorter text hasn't is no better than the one before it, and at the end one that starts so than the one after.
        fit &= np.where(high < size, letters[high - 1], letters[low] | (low == 0))
        if have is not None:
            count = have[np.maximum(high - 2, low).clip(0, size - 2)] - have[low.clip(0, size - 2)]
            fit &= count >= share * (n + high - low) - 2 - 1e-9
        return list(zip(low[fit].tolist(), high[fit].tolist()))


def _fours(codes: np.ndarray) -> np.ndarray:
    """A number for each four letters in a row; two that share one only make more parts look alike."""
    n, out = max(len(codes) - 3, 0), 0
    for k in range(4):
        out = out * 1_000_003 + codes[k : k + n]
    return out


class Sieve:
    """Many short texts, of which only those are to be looked for in a longer one that can be ``least`` like a part of it.

    As with triples (:meth:`Searched.windows`), a part of length w that is t
    percent like a text of length n has at least (7 t / 200 - 3) (n + w) - 3 of
    its fours of letters.  A longer text is cut into blocks of an eighth of n, so
    such a part lies in nine of them.
    """

    _EIGHTH, _SPAN = 8, 9

    def __init__(self, texts: list[str], least: float):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.needed = (7 * least / 200 - 3) * self.sizes * 200 / (200 - least) - 3 - 1e-9
        own = [np.unique(_fours(_codes(t))) for t in texts]
        every = np.concatenate([*own, np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(texts)), [len(x) for x in own])[order]
        self.fours, self.first, self.many = np.unique(every[order], return_index=True, return_counts=True)

    def fit(self, long: str) -> np.ndarray:
        """Which of the texts can be like a part of ``long``; those that are longer than it always count."""
        size = len(long)
        fit = (self.sizes > size) | (self.needed <= 0)
        if fit.all() or not len(self.fours):
            return fit
        fours = _fours(_codes(long))
        at = np.searchsorted(self.fours, fours).clip(max=len(self.fours) - 1)
        place = np.flatnonzero(self.fours[at] == fours)
        at = at[place]
        many = self.many[at]
        owner = self.owner[np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        step = np.maximum(-(-self.sizes // self._EIGHTH), 1)
        used = size // step + 1
        blocks = used + self._SPAN
        base = np.cumsum(blocks) - blocks
        counts = np.bincount(base[owner] + np.repeat(place, many) // step[owner], minlength=int(blocks.sum()))
        total = np.concatenate([[0], np.cumsum(counts)])
        sums = total[self._SPAN :] - total[: -self._SPAN]
        # Sums that begin behind the last block are of the next text.
        inside = (np.arange(blocks.sum()) - np.repeat(base, blocks) < np.repeat(used, blocks))[: len(sums)]
        return fit | (np.maximum.reduceat(np.where(inside, sums, 0), base) >= self.needed)


class Parts:
    """Texts of which only those are to be looked for in longer ones that can be ``least`` like a part of them.

    A part of length w that is t percent like a text of length n has at least
    t (n + w) / 200 letters of it in order, and so has every stretch that holds
    the part.  The longer texts are therefore cut into overlapping stretches, two
    fifths of a text longer than one, and letters in order are counted for all
    texts of about one size and many stretches side by side (:class:`_Alongside`).
    Where a stretch has enough of them it is cut finer for that text alone.
    Texts longer than the longer one always count.
    """

    _SPREAD = 1.25

    def __init__(self, texts: list[str], least: float):
        self.sizes, self.groups = np.array([len(t) for t in texts], np.int64), []
        order = np.argsort(self.sizes, kind="stable").tolist()
        while order:
            most = self._SPREAD * len(texts[order[0]])
            own = [k for k in order if len(texts[k]) <= most]
            order = order[len(own) :]
            self.groups.append((np.array(own), _Alongside([texts[k] for k in own], least)))

    def fit(self, long: str) -> np.ndarray:
        """Which of the texts can be like a part of ``long``."""
        return self.fits([long])[0]

    def fits(self, longs: list[str]) -> np.ndarray:
        """A row for each of ``longs``: which of the texts can be like a part of it."""
        out = self.sizes > np.array([len(x) for x in longs], np.int64)[:, None]
        for own, group in self.groups:
            some = np.flatnonzero(~out[:, own].all(1))
            if len(some):
                out[np.ix_(some, own)] |= group.fits([longs[k] for k in some.tolist()])
        return out


class _Alongside:
    """Texts of about one size, shortest first, each in words of 63 bits, whose highest bit takes what is carried on."""

    #: The bits of a word that hold letters, and the counts, of a text in a stretch, that are worked on at a time.
    _BITS, _LANES = 63, 1 << 15

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least, self.sizes = texts, least, np.array([len(t) for t in texts], np.int64)
        self.finders: dict[int, Subsequence] = {}
        words = max(1, -(-int(self.sizes[-1]) // self._BITS))
        self.letters = np.unique(np.concatenate([*[_codes(t) for t in texts], np.zeros(1, np.int64)]))
        # The last letter is any that no text has.
        self.places = np.zeros((words, len(self.letters) + 1, len(texts)), np.uint64)
        self.full = np.zeros((words, len(texts)), np.uint64)
        for k, text in enumerate(texts):
            place = np.arange(len(text))
            bit = np.uint64(1) << (place % self._BITS).astype(np.uint64)
            np.bitwise_or.at(self.places, (place // self._BITS, np.searchsorted(self.letters, _codes(text)), k), bit)
            np.bitwise_or.at(self.full, (place // self._BITS, k), bit)

    def _stretches(self, size: int) -> list[tuple[int, int, int, int]]:
        """(start, end, how many parts begin in it, length of the shortest of them) that hold all parts of a text of ``size`` letters that can be alike."""
        small, big = int(self.sizes[0]), int(self.sizes[-1])
        step, fine = max(1, small * 2 // 5), max(1, small // 6)
        # Shorter parts, which only the ends have, can't be alike.
        short = max(1, int(self.least * small / (200 - self.least)))
        out = [(0, min(w + fine, size), 1, w) for w in range(short, min(big, size), fine)]
        at = 0
        while at == 0 or size - at >= short:
            many = step if at + step - 1 + big <= size else fine
            out.append((at, min(at + many - 1 + big, size), many, min(big, max(size - at - many + 1, 1))))
            at += many
        return out

    def _common(self, letters: list[np.ndarray]) -> np.ndarray:
        """For each stretch (its letters' numbers, longest first) a row of how many letters of each text it has in order."""
        words, _, texts = self.places.shape
        sizes = np.array([len(x) for x in letters])
        passing = np.full((int(sizes[0]), len(letters)), len(self.letters), np.intp)
        for k, x in enumerate(letters):
            passing[: len(x), k] = x
        rest = np.repeat(self.full[:, None], len(letters), axis=1)
        there, hit, more, carry = (np.empty(rest.shape[1:], np.uint64) for _ in range(4))
        top, low = np.uint64(self._BITS), np.uint64((1 << self._BITS) - 1)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        for t, n in enumerate(active.tolist()):
            place, met, total, on = there[:n], hit[:n], more[:n], carry[:n]
            for w in range(words):
                own = rest[w, :n]
                np.take(self.places[w], passing[t, :n], axis=0, out=place, mode="clip")
                np.bitwise_and(own, place, out=met)
                np.add(own, met, out=total)
                if w:
                    np.add(total, on, out=total)
                if w < words - 1:
                    np.right_shift(total, top, out=on)
                    np.bitwise_and(total, low, out=total)
                np.bitwise_xor(own, met, out=own)
                np.bitwise_or(own, total, out=own)
        left = np.bitwise_count(rest & self.full[:, None]).astype(np.int64).sum(0)
        return self.sizes - left

    def fits(self, longs: list[str]) -> np.ndarray:
        """A row for each of ``longs``: which of the texts can be like a part of it; of those longer than it nothing is said."""
        out, cut = np.zeros((len(longs), len(self.texts)), bool), []
        for k, long in enumerate(longs):
            codes = _codes(long)
            at = np.searchsorted(self.letters, codes).clip(max=len(self.letters) - 1)
            letters = np.where(self.letters[at] == codes, at, len(self.letters))
            cut += [(k, *x, letters) for x in self._stretches(len(long))]
        cut.sort(key=lambda x: x[1] - x[2])
        some = max(1, self._LANES // len(self.texts))
        for low in range(0, len(cut), some):
            part = cut[low : low + some]
            common = self._common([x[5][x[1] : x[2]] for x in part])
            window = np.minimum(self.sizes, np.array([x[4] for x in part])[:, None])
            for i, j in zip(*(x.tolist() for x in np.nonzero(200 * common >= self.least * (self.sizes + window) - 1e-6)), strict=True):
                k, start, _, many, window_of, _ = part[i]
                if not out[k, j]:
                    out[k, j] = window_of < self.sizes[j] or self._closer(j, longs[k], start, many)
        return out

    def _closer(self, k: int, long: str, start: int, many: int) -> bool:
        """Whether a text can be like one of ``many`` whole parts from ``start`` on, by halves."""
        n = len(self.texts[k])
        if k not in self.finders:
            self.finders[k] = Subsequence(self.texts[k])
        runs = [(start, many)]
        while runs:
            at, many = runs.pop()
            if 100 * self.finders[k].common(long[at : at + many - 1 + n]) >= self.least * n - 1e-6:
                if many <= max(1, n // 16):
                    return True
                runs += [(at + many // 2, many - many // 2), (at, many // 2)]
        return False


def _best_window(finder: Subsequence, long: str, windows: list[tuple[int, int]], least: float) -> tuple[float, int, int]:
    """The first of the best windows, by halving runs of them.

    No window has more letters in order than the stretch that holds a run of
    them, so a run whose stretch has too few is left out as a whole.
    """
    # The more has to be in common, the longer a stretch can be that has too little.
    n, step = len(finder.text), max(8, len(finder.text) // (2 if least >= 80 else 8))
    best = (0.0, 0, n)
    runs: list[list[tuple[int, int]]] = []
    for w in windows:
        if not runs or w[0] >= runs[-1][0][0] + step:
            runs.append([])
        runs[-1].append(w)
    runs.reverse()
    while runs:
        run = runs.pop()
        if len(run) == 1:
            low, high = run[0]
            found = finder.ratio(long[low:high])
            if found > best[0] and found >= least:
                best = found, low, high
            continue
        most = finder.common(long[run[0][0] : max(high for _, high in run)])
        reach = max(100.0 * 2 * min(most, high - low) / (n + high - low) for low, high in run)
        if reach >= least and reach > best[0]:
            half = len(run) // 2
            runs += [run[half:], run[:half]]
    return best


def partial(a: str, b: str, least: float = 0.0, searched: Searched | None = None) -> tuple[float, int, int]:
    """The best ratio of the shorter text to a part of the longer one not longer than it, and that part's ends in b.

    Parts that start at the longer text's front or stop at its end may be
    shorter.  Of parts as good the first counts; below ``least`` nothing is found.
    ``searched`` spares numbering b again for each a.
    """
    if not a or not b:
        return (100.0 if a == b else 0.0), 0, 0
    short, long, turned = (a, b, False) if len(a) <= len(b) else (b, a, True)
    at = long.find(short)
    best = (100.0, at, at + len(short)) if at >= 0 else (0.0, 0, len(short))
    if at < 0:
        windows = (searched if searched and searched.text == long else Searched(long)).windows(short, least)
        if windows:
            best = _best_window(Subsequence(short), long, windows, least)
    if best[0] < least:
        return 0.0, 0, 0
    return (best[0], 0, len(b)) if turned else best


# ---------------------------------------------------------------- many pairs at once

#: Letters of the shorter and of the longer text up to which pairs are compared side by side, and the machine words that are worked on at a time.
_SHORT, _LONG, _STRIDE = 63, 255, 1 << 15


def _padded(texts: list[str], width: int, blank: int) -> np.ndarray:
    """The letters' codes, a row a text, with ``blank`` behind them."""
    joined = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width).astype(np.int32)
    sizes = np.array([len(t) for t in texts])
    return np.where(np.arange(width) < sizes[:, None], joined, blank)


def _places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each letter of the longer texts a bit for each place at which the shorter one has it."""
    out = np.zeros(long.shape, np.uint64)
    for i in range(short.shape[1]):
        out |= (short[:, i][:, None] == long).astype(np.uint64) << np.uint64(i)
    return out


def _side_by_side(pairs: list[tuple[str, str]], one, many) -> list[float]:
    """``many`` for pairs (shorter, longer) that fit into machine words, in strides of pairs of like sizes; ``one`` for the others."""
    out = [0.0] * len(pairs)
    fit = []
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if short and len(short) <= _SHORT and len(long) <= _LONG:
            fit.append((len(long), len(short), k, short, long))
        else:
            out[k] = float(one(a, b))
    fit.sort(key=lambda x: x[:3], reverse=True)
    at = 0
    while at < len(fit):
        part = fit[at : at + max(1, _STRIDE // fit[at][0])]
        at += len(part)
        part.sort(key=lambda x: -x[1])
        short, long = [x[3] for x in part], [x[4] for x in part]
        n, m = np.array([x[1] for x in part]), np.array([x[0] for x in part])
        found = many(_places(_padded(short, int(n.max()), -1), _padded(long, int(m.max()), -2)), n, m)
        for x, v in zip(part, found.tolist(), strict=True):
            out[x[2]] = v
    return out


def _many_ratios(places: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    rest = np.full(len(n), ~np.uint64(0))
    for j in range(places.shape[1]):
        hit = rest & places[:, j]
        rest = (rest + hit) | (rest - hit)
    return 100.0 * 2 * np.bitwise_count(~rest).astype(np.int64) / (n + m)


def _many_partials(places: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The best ratio of each shorter text, sizes ``n`` falling, to a part of the longer one: all parts that start anywhere, grown letter by letter up to its size."""
    pairs, size = places.shape
    reach = int(n[0])
    places = np.concatenate([places, np.zeros((pairs, reach), np.uint64)], axis=1)
    rest = np.full((pairs, size), ~np.uint64(0))
    best = np.zeros(pairs)
    for t in range(reach):
        k = int(np.searchsorted(-n, -t, "left"))  # those longer than t
        hit = rest[:k] & places[:k, t : t + size]
        rest[:k] = (rest[:k] + hit) | (rest[:k] - hit)
        # Parts at the front may be shorter.
        front = 100.0 * 2 * np.bitwise_count(~rest[:k, 0]).astype(np.int64) / (n[:k] + np.minimum(t + 1, m[:k]))
        best[:k] = np.maximum(best[:k], front)
    # Parts that reach the end are as long as what is left there.
    lengths = np.minimum(n[:, None], m[:, None] - np.arange(size))
    common = np.bitwise_count(~rest).astype(np.int64)
    ratios = np.where(lengths > 0, 100.0 * 2 * common / (n[:, None] + np.maximum(lengths, 1)), 0.0)
    return np.maximum(best, ratios.max(axis=1))


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """:func:`ratio` of many pairs."""
    return _side_by_side(pairs, ratio, _many_ratios)


def token_sets(pairs: list[tuple[str, str]]) -> list[float]:
    """:func:`token_set` of many pairs."""
    apart = [_words_apart(a, b) for a, b in pairs]
    whole = iter(ratios([x[1:] for x in apart if not isinstance(x, float)]))
    return [x if isinstance(x, float) else _best_of_words(*x, next(whole)) for x in apart]


#: Texts of so many that are compared with all others at a time.
_STRIP = 64


class WordTable:
    """Texts whose distinct words, sorted and joined, fit into machine words, to be held against all of another table at once."""

    def __init__(self, texts: list[str]):
        self.words = [sorted(set(t.split())) for t in texts]
        self.joined = [" ".join(w) for w in self.words]
        self.sizes = np.array([len(j) for j in self.joined], np.int64)
        #: For each word: the texts that have it, and there its places with the blank behind it, which the last one hasn't.
        self.places: dict[str, tuple[list[int], list[int]]] = {}
        for i, words in enumerate(self.words):
            at = 0
            for word in words:
                rows, bits = self.places.setdefault(word, ([], []))
                rows.append(i)
                bits.append(((1 << len(word) + 1) - 1) << at)
                at += len(word) + 1

    @staticmethod
    def fits(joined: str) -> bool:
        return len(joined) <= _SHORT

    def letters(self) -> np.ndarray:
        return _padded(self.joined, int(self.sizes.max(initial=0)), -1)


def _stay(gone: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places that are left of texts of these sizes without the words at ``gone``; if the last word goes, so does the blank before it."""
    one = np.uint64(1)
    end = one << sizes.astype(np.uint64)
    stay = (end - one) & ~gone
    top = stay.copy()
    for n in (1, 2, 4, 8, 16, 32):
        top |= top >> np.uint64(n)
    return np.where((gone & end) > 0, stay & ~(top ^ (top >> one)), stay)


def token_set_table(a: WordTable, b: WordTable) -> np.ndarray:
    """:func:`token_set` of every text of a with every text of b.

    Words that both have begin either side and count whole.  Their letters are
    masked out in both, and the others compared letter by letter for all pairs
    side by side.
    """
    shape = len(b.words), len(a.words)
    out = np.zeros(shape)
    if not out.size:
        return out.T
    gone_a, gone_b = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    shared, held = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for word in a.places.keys() & b.places.keys():
        (of_a, bits_a), (of_b, bits_b) = a.places[word], b.places[word]
        met = np.ix_(of_b, of_a)
        gone_a[met] |= np.array(bits_a, np.uint64)[None]
        gone_b[met] |= np.array(bits_b, np.uint64)[:, None]
        shared[met] += 1
        held[met] += len(word)
    letters_a, letters_b = a.letters(), b.letters()
    known = np.unique(letters_a[letters_a >= 0])
    masks = np.zeros((len(known) + 1, shape[1]), np.uint64)
    for i in range(letters_a.shape[1]):
        rows = np.flatnonzero(letters_a[:, i] >= 0)
        masks[np.searchsorted(known, letters_a[rows, i]), rows] |= np.uint64(1 << i)
    # Letters that no text of a has are numbered last, where no place is noted.
    at = np.searchsorted(known, letters_b)
    at[~np.isin(letters_b, known)] = len(known)
    count_a, count_b = np.array([len(w) for w in a.words]), np.array([len(w) for w in b.words])
    for low in range(0, shape[0], _STRIP):
        part = slice(low, low + _STRIP)
        stay_a, stay_b = _stay(gone_a[part], a.sizes[None]), _stay(gone_b[part], b.sizes[part, None])
        rest, left = np.full(stay_a.shape, ~np.uint64(0)), stay_b.copy()
        for t in range(int(b.sizes[part].max())):
            hit = masks[at[part, t]]
            hit *= left & np.uint64(1)
            left >>= np.uint64(1)
            hit &= stay_a
            hit &= rest
            less = rest - hit
            rest += hit
            rest |= less
        common, n = np.bitwise_count(~rest).astype(np.int64), shared[part]
        both = held[part] + np.maximum(n - 1, 0)
        ahead = np.where(n > 0, both + 1, 0)
        one, two = ahead + np.bitwise_count(stay_a), ahead + np.bitwise_count(stay_b)
        whole = 100.0 * 2 * (ahead + common) / np.maximum(one + two, 1)
        found = np.where(n > 0, np.maximum(whole, 100.0 * 2 * both / np.maximum(both + np.minimum(one, two), 1)), whole)
        found[(n > 0) & ((n == count_a[None]) | (n == count_b[part, None]))] = 100.0
        out[part] = np.where((count_a[None] > 0) & (count_b[part, None] > 0), found, 0.0)
    return out.T


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    """The score of :func:`partial` of many pairs."""
    return _side_by_side(pairs, lambda a, b: partial(a, b)[0], _many_partials)


def _pairs(many):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        found = iter(many(both))
        return pd.Series([None if x is None or y is None else next(found) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


_RATIO, _TOKEN_SET, _PARTIAL = _pairs(ratios), _pairs(token_sets), _pairs(partials)
_PART = StructType([StructField("score", DoubleType()), StructField("start", LongType()), StructField("stop", LongType())])


@pandas_udf(_PART)
def partial_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """score, start and stop of the part of b that is most like a."""
    return pd.DataFrame([partial(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["score", "start", "stop"])


def ratio_of(a: Column, b: Column) -> Column:
    return _RATIO(a, b)


def token_set_of(a: Column, b: Column) -> Column:
    """The token-set ratio; where one side's words are all in the other's it needs no Python."""
    x, y = F.array_distinct(F.split(F.trim(a), r"\s+")), F.array_distinct(F.split(F.trim(b), r"\s+"))
    empty = (F.trim(a) == "") | (F.trim(b) == "")
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when(empty, 0.0).when(inside, 100.0).otherwise(_TOKEN_SET(F.when(~inside, a), F.when(~inside, b)))


def partial_of(a: Column, b: Column, least: float = 0.0) -> Column:
    """The partial ratio, 0 below ``least``, which spares most of the work."""
    return _pairs(lambda pairs: [partial(x, y, least)[0] for x, y in pairs])(a, b) if least else _PARTIAL(a, b)
