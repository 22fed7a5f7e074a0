"""All pairs of publications that score high enough to be one record, found tile by tile.

The score counts common letters of whole titles and texts, so two titles may
reach it without a word, a pair of letters or a length in common: no index on
words or letter runs finds all pairs.  Rows are therefore cut into chunks of
equal size a window of days, only chunks of windows that can meet are compared,
and a bound on the score from letter counts, worked out for a whole tile at once,
spares most pairs the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.similarity import Subsequence, WordTable, token_set, token_set_table
from docketry.functions.text import ISSUER_PARENT, tr_lower

from . import tiles

#: The shares of title, text and issuer with and without texts, what an unknown issuer counts, and the part of a text that is compared.
WITH_TEXT, WITHOUT_TEXT, UNKNOWN_ISSUER, HEAD = (0.6, 0.3, 0.1), (0.85, 0.15), 0.5, 2000
#: Classes of letters that are counted; more letters in a class only raise the bound.
_CLASSES = 64


@dataclass(frozen=True)
class PairRules:
    days: int = 7
    review: float = 0.70
    chunk: int = 256


def compatible(a: str | None, b: str | None) -> bool:
    return not a or not b or a == b or ISSUER_PARENT.get(a) == b or ISSUER_PARENT.get(b) == a


def score(title: float, text: float | None, issuer: float) -> float:
    """0 to 1 from shares of titles, texts (None if either has none) and issuers."""
    if text is None:
        return WITHOUT_TEXT[0] * title + WITHOUT_TEXT[1] * issuer
    return WITH_TEXT[0] * title + WITH_TEXT[1] * text + WITH_TEXT[2] * issuer


class Titles:
    """A chunk's titles, with what the bounds are made of."""

    def __init__(self, chunk: list):
        self.ids = np.array([r["doc_id"] for r in chunk], np.int64)
        self.days = np.array([np.nan if r["day"] is None else r["day"] for r in chunk])
        self.issuers = [r["issuer"] for r in chunk]
        self.titles = [r["title"] or "" for r in chunk]
        self.words = [sorted(set(t.split())) for t in self.titles]
        self.joined = [" ".join(w) for w in self.words]
        self.title_sizes = np.array([len(j) for j in self.joined], np.float64)

    @cached_property
    def title_counts(self) -> np.ndarray:
        return _counts(self.joined)


class _Side(Titles):
    def __init__(self, chunk: list):
        super().__init__(chunk)
        self.sources = [r["source"] for r in chunk]
        self.heads = [r["head"] or "" for r in chunk]
        self.head_sizes = np.array([len(h) for h in self.heads], np.float64)
        #: Titles that are compared with all short ones at once.
        self.short = np.flatnonzero([WordTable.fits(j) for j in self.joined])

    @cached_property
    def head_counts(self) -> np.ndarray:
        return _counts(self.heads)


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _CLASSES), np.int32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % _CLASSES
        out[i] = np.bincount(codes, minlength=_CLASSES)
    return out


def _letters_in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least the length of the longest common subsequence of each two texts."""
    out = np.zeros((len(a), len(b)))
    for c in range(_CLASSES):
        out += np.minimum(a[:, c][:, None], b[:, c][None])
    return out


def _share(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * common / np.maximum(a[:, None] + b[None], 1)


def issuers_fit(a: Titles, b: Titles) -> tuple[np.ndarray, np.ndarray]:
    """Which two issuers are compatible, and which of them are both known."""
    fit, known = np.ones((len(a.ids), len(b.ids)), bool), np.zeros((len(a.ids), len(b.ids)), bool)
    names_a, names_b = ({n: [k for k, x in enumerate(side.issuers) if x == n] for n in set(side.issuers)} for side in (a, b))
    for x, rows in names_a.items():
        for y, columns in names_b.items():
            fit[np.ix_(rows, columns)] = compatible(x, y)
            known[np.ix_(rows, columns)] = bool(x and y)
    return fit, known


def title_bound(a: Titles, b: Titles) -> np.ndarray:
    """No title share is above it: letters in common of the distinct words, or the words that both have against either title."""
    shared = np.zeros((len(a.ids), len(b.ids)))
    places: dict[str, list[int]] = {}
    for j, words in enumerate(b.words):
        for w in words:
            places.setdefault(w, []).append(j)
    for i, words in enumerate(a.words):
        for w in words:
            if w in places:
                shared[i, places[w]] += len(w) + 1
    least = np.minimum(a.title_sizes[:, None], b.title_sizes[None])
    same = np.where(shared > 0, 2 * (shared - 1) / np.maximum(shared - 1 + least, 1), 0)
    return np.minimum(1, np.maximum(_share(_letters_in_common(a.title_counts, b.title_counts), a.title_sizes, b.title_sizes), same))


def _short_titles(a: _Side, b: _Side) -> np.ndarray:
    """The token-set ratios of all short titles; each different title is compared once."""
    sides = []
    for side in (a, b):
        names, at = np.unique([side.joined[i] for i in side.short], return_inverse=True)
        sides.append((WordTable(names.tolist()), at))
    (x, of_a), (y, of_b) = sides
    return token_set_table(x, y)[np.ix_(of_a, of_b)]


def pairs_of_tile(left: list, right: list, same: bool, rules: PairRules) -> Iterator[tuple[int, int, float]]:
    """(smaller id, larger id, score) of the pairs of two chunks that reach ``review``; ``same``: both are one chunk."""
    a, b = _Side(left), _Side(right)
    code = {s: k for k, s in enumerate({*a.sources, *b.sources})}
    of = lambda side: np.array([code[s] for s in side.sources])
    near = np.abs(a.days[:, None] - b.days[None])
    fit = (of(a)[:, None] != of(b)[None]) & (a.ids[:, None] != b.ids[None]) & (np.isnan(near) | (near <= rules.days))
    if same:
        fit &= np.triu(np.ones(fit.shape, bool), 1)
    match, known = issuers_fit(a, b)
    fit &= match
    issuer = np.where(known, 1.0, UNKNOWN_ISSUER)
    texts = (a.head_sizes[:, None] > 0) & (b.head_sizes[None] > 0)
    text_bound = _share(_letters_in_common(a.head_counts, b.head_counts), a.head_sizes, b.head_sizes) if texts.any() else np.zeros(fit.shape)
    short = np.ix_(a.short, b.short)
    whole = len(a.short) == len(a.ids) and len(b.short) == len(b.ids)
    most = np.zeros(fit.shape) if whole else title_bound(a, b)
    exact = np.zeros(fit.shape, bool)
    if fit[short].any():
        exact[short], most[short] = True, _short_titles(a, b) / 100
    # What rounding may add to a bound is far below this.
    fit &= np.where(texts, score(most, text_bound, issuer), score(most, None, issuer)) >= rules.review - 1e-9
    # Without texts a title that was compared settles the pair.
    found = score(most, None, issuer)
    settled = fit & exact & ~texts
    fit &= ~settled
    i, j = np.nonzero(settled & (found >= rules.review))
    yield from zip(np.minimum(a.ids[i], b.ids[j]).tolist(), np.maximum(a.ids[i], b.ids[j]).tolist(), found[i, j].tolist(), strict=True)
    titles: dict[tuple[str, str], float] = {}
    heads: dict[tuple[str, str], float] = {}
    for i in np.flatnonzero(fit.any(1)).tolist():
        head = None
        for j in np.flatnonzero(fit[i]).tolist():
            key = a.joined[i], b.joined[j]
            if key not in titles:
                titles[key] = float(most[i, j]) if exact[i, j] else token_set(a.titles[i], b.titles[j]) / 100
            title, text = titles[key], None
            if texts[i, j]:
                if score(title, text_bound[i, j], issuer[i, j]) < rules.review - 1e-9:
                    continue
                key = a.heads[i], b.heads[j]
                if key not in heads:
                    head = head or Subsequence(a.heads[i])
                    heads[key] = head.ratio(b.heads[j]) / 100
                text = heads[key]
            found = score(title, text, issuer[i, j])
            if found >= rules.review:
                yield (*sorted((int(a.ids[i]), int(b.ids[j]))), float(found))


def fuzzy_candidates(docs: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Pairs (a, b, score), a < b, of documents of different sources, compatible issuers and at most ``days`` apart, from ``review`` on.

    ``docs``: doc_id, source, issuer, day, title_key, text; a document without a
    day may belong to any, null titles and texts are empty.  Every pair that
    scores is found.  The work grows with the square of the documents of a week,
    spread over tiles of ``chunk`` x ``chunk`` pairs; copies are scored once a tile.
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    doc = F.col("doc_id").cast("long")
    facts = F.struct(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), "issuer", day.alias("day"), F.col("title_key").alias("title"), tr_lower(F.substring("text", 1, HEAD)).alias("head"))
    rows = docs.where("doc_id is not null").select(tiles.window_of(F.col("day"), rules.days).alias("w"), doc.alias("key"), facts.alias("r"))
    side = tiles.Side(rows, "docs", rules.chunk)
    return tiles.compare(side, side, range(2), lambda a, b, same: pairs_of_tile(a, b, same, rules), "a long, b long, score double")
