"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles.  SetSketch gives every set
``m`` registers: for each of ``m`` hash functions the least hash among the
elements, read as an exponential variable and put on a scale of powers of
``base``, so registers of a union are the larger ones of both (mergeable), and
equal registers are about as likely as the Jaccard similarity.

1. Documents with equal sets become one node.
2. Runs of ``rows`` registers are the bands; nodes with an equal band meet in
   a bucket.  At similarity 0.8 a pair misses all of 24 bands of 4 with a
   chance of 3e-6.
3. Shingles that no other node in any bucket has are counted.  They bound the
   similarity of a pair from above, so nodes with too many of them have no
   link, and pairs with too many of them between them aren't made.
4. In each bucket of several components the members are compared with one
   centre, at first the node with the least share of such shingles.  Pairs that
   pass the likelihood estimate from both sketches are checked on the full
   sets, and links join components.
5. What is still apart after ``star_rounds`` such rounds is compared in full:
   members outside a bucket's largest component against all its members of
   other components.  So a link between components can't be missed, and pairs
   within one component, of which large groups of copies have most, are never
   made.  Nor are pairs which what is known of both against the bucket's first
   centre proves to be no link: what both have unlike the centre isn't more
   than what either has so without its own shingles, nor more than what either
   has so in each of ``cells`` cells by hash, summed up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, giving_back, runs_of_bytes, staged, text_of
from .components import components

_BLOCK = 1 << 16


@dataclass(frozen=True)
class Sketches:
    """words: length of a shingle; percent: least similarity; base, rate, most: SetSketch's b, a and q.

    margin: pairs whose estimate is that much under the least similarity (about
    six standard errors) aren't checked; broadcast_rows: ids sent to all tasks at most; cells: counts kept of what a node has unlike a centre.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    most: int = 65534
    margin: float = 0.25
    star_rounds: int = 3
    broadcast_rows: int = 100_000
    cells: int = 128

    @property
    def m(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; with fewer words the whole sequence is one."""
    found = text.lower().split()
    n = min(words, len(found))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _halves(shingles: bytes) -> tuple[int, int]:
    """A 128-bit hash of a whole set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(shingles)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketch(sets: list[np.ndarray], setup: Sketches) -> np.ndarray:
    """Registers of non-empty sets, a row each."""
    rng = np.random.default_rng(8)
    factors = rng.integers(1 << 62, 1 << 63, setup.m, np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, setup.m, np.uint64)
    least = np.full((len(sets), setup.m), np.iinfo(np.uint64).max, np.uint64)
    for lo, hi in runs_of_bytes([x.view(np.uint8) for x in sets], 8 * _BLOCK):
        elements = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(x) for x in sets[lo : hi - 1]])
        for i in range(setup.m):
            least[lo:hi, i] = np.minimum.reduceat((elements ^ masks[i]) * factors[i], starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / setup.rate
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(setup.base)), 0, setup.most + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, setup: Sketches) -> float:
    """The Jaccard similarity of the greatest likelihood, given both registers and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.linspace(0, min(u / v, v / u), 129)
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (setup.base - 1) / setup.base) / np.log(setup.base)
    more, less = step(u - v * j), step(v - u * j)
    d_more, d_less = int((a > b).sum()), int((a < b).sum())
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return float(j[np.argmax(d_more * log(more) + d_less * log(less) + (len(a) - d_more - d_less) * log(1 - more - less))])


def _sketched(docs: DataFrame, setup: Sketches) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for lo, hi in runs_of_bytes(texts, 1 << 22):
                sets = [shingle_set(x, setup.words, hashes) for x in texts[lo:hi]]
                full = [x for x in sets if len(x)]
                rows = iter([x.tobytes() for x in sketch(full, setup)])
                ids = [_halves(x.tobytes()) for x in sets]
                halves = [pa.array([x[k] for x in ids], pa.int64()) for k in (0, 1)]
                registers = pa.array([next(rows) if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), *halves, registers], ["doc_id", "n_shingles", "s1", "s2", "registers"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(giving_back(run), f"doc_id {id_type}, n_shingles long, s1 long, s2 long, registers binary")


def _banded(nodes: DataFrame, setup: Sketches) -> DataFrame:
    """node, key: a row for each band."""
    odd = np.random.default_rng(9).integers(1 << 62, 1 << 63, setup.bands, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, setup.bands, setup.rows)
            key = np.zeros(registers.shape[:2], np.uint64)
            for k in range(setup.rows):
                key = (key ^ registers[:, :, k]) * odd
                key ^= key >> np.uint64(31)
            at = pa.array(np.repeat(np.arange(len(key)), setup.bands))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array(key.ravel().view(np.int64))], ["node", "key"])

    return nodes.select("node", "registers").mapInArrow(giving_back(run), f"node {nodes.schema['node'].dataType.simpleString()}, key long")


def _likely(pairs: DataFrame, nodes: DataFrame, setup: Sketches) -> DataFrame:
    """The pairs (a, b) whose estimate comes near the least similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    # The ratio of the sizes bounds the similarity.
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= setup.percent * F.greatest("n_a", "n_b"))
    least = setup.percent / 100 - setup.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("r_a", "r_b", "n_a", "n_b")]
            near = [estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m, setup) >= least for x, y, n, m in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return sized.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(giving_back(run), pairs.select("a", "b").schema)


def _linked(pairs: DataFrame, sets: DataFrame, setup: Sketches, cells: int = 0) -> DataFrame:
    """a, b, apart (elements that one has and the other hasn't), unlike (their counts by cell, if
    ``cells`` isn't 0), and linked: whether the full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    few = 2 * pairs.count() <= setup.broadcast_rows
    own = sets.join(F.broadcast(ids) if few else ids, "node", "left_semi")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, unlike, linked = [], [], []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                other = np.setxor1d(s, t, assume_unique=True)
                apart.append(len(other))
                common = (len(s) + len(t) - apart[-1]) // 2
                unlike.append(np.bincount((other % np.uint64(cells)).astype(np.int64), minlength=cells) if cells else None)
                linked.append(100 * common >= setup.percent * (common + apart[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart, pa.int64()), pa.array(unlike, pa.list_(pa.int32())), pa.array(linked, pa.bool_())], ["a", "b", "apart", "unlike", "linked"])

    id_type = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "s_a", "s_b").mapInArrow(giving_back(run), f"a {id_type}, b {id_type}, apart long, unlike array<int>, linked boolean")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """node, size, own: how many shingles it has, and how many that no other node of ``sets`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array(np.concatenate(each) if each else np.empty(0, np.int64))], ["node", "shingle"])

    shingles = sets.mapInArrow(giving_back(run), f"node {sets.schema['node'].dataType.simpleString()}, shingle long")
    once = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    sized = sets.groupBy("node").agg(F.min(F.octet_length("shingles") / 8).cast("long").alias("size"))
    return sized.join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _may_link(percent: int) -> Column:
    """Whether nodes p and o can be similar enough, by what is known of both.

    Neither's own shingles are in common and all are in the union.  Of what p
    and o have unlike a centre, own shingles are unlike for one of them only,
    and in each cell no more than the lesser count is unlike for both.
    """
    size, own, apart = ((F.col(f"p.{c}"), F.col(f"o.{c}")) for c in ("size", "own", "apart"))
    common = F.least(size[0] - own[0], size[1] - own[1])
    union = F.greatest(common + own[0] + own[1], *size)
    unlike = apart[0] + apart[1] - 2 * F.least(apart[0] - own[0], apart[1] - own[1])
    near = (100 + percent) * unlike <= (100 - percent) * (size[0] + size[1])
    shared = F.aggregate(F.zip_with("p.unlike", "o.unlike", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    close = (100 + percent) * (apart[0] + apart[1] - 2 * shared) <= (100 - percent) * (size[0] + size[1])
    return (100 * common >= percent * union) & F.coalesce(near, F.lit(True)) & F.coalesce(close, F.lit(True))


def _with_distances(buckets: DataFrame, centres: DataFrame, checked: DataFrame, labels: DataFrame, cells: int) -> DataFrame:
    """The buckets that still have several components, with ``apart`` and ``unlike`` of members
    from the bucket's centre, where they were counted."""
    placed = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    known = checked.select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("apart").alias("counted"), F.col("unlike").alias("by_cell"))
    known = known.union(checked.select("b", "a", "apart", "unlike"))
    placed = buckets.join(several, "key").join(centres, "key", "left").join(known, ["node", "centre"], "left")
    itself = F.col("node") == F.col("centre")
    apart = F.when(itself, F.lit(0)).otherwise(F.col("counted")).cast("long")
    unlike = F.when(itself, F.array_repeat(F.lit(0), cells)).otherwise(F.col("by_cell"))
    return placed.select("node", "key", "size", "own", apart.alias("apart"), unlike.alias("unlike"))


def _full_sets(docs: DataFrame, wanted: DataFrame, setup: Sketches) -> DataFrame:
    """node, shingles of the wanted nodes, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(x, setup.words, hashes).tobytes() for x in byte_texts(batch.column("text"))]
            meant = [_halves(x)[0] == s1 for x, s1 in zip(found, batch.column("s1").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"]).filter(pa.array(meant, pa.bool_()))

    texts = docs.select(F.col("doc_id").alias("node"), text_of().alias("text")).join(wanted, "node")
    kind = f"node {wanted.schema['node'].dataType.simpleString()}, shingles binary"
    return texts.select("node", "text", "s1").mapInArrow(giving_back(run), kind).dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, setup: Sketches = Sketches()) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Documents are linked whose sets of word shingles (lower-case A-Z, words
    parted by ASCII white space) are similar by ``percent`` or more;
    ``component_id`` is the smallest id that a document reaches, and the
    document with that id is kept.  A null or empty text has an empty set and no
    link.  Rows of one id are one document: the row with the most shingles is
    compared, and all get its component.  A row without id is linked to
    nothing: its component_id is null and it is kept.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = staged(_sketched(docs, setup), "sketches")
    one = every.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "s1", "s2")).alias("set")).select("doc_id", "set.*")
    # Equal sets have their smallest id as node.
    sets = one.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    members = staged(one.join(sets, ["s1", "s2"]).select("doc_id", "node"), "members")
    chosen = every.join(sets.withColumnRenamed("node", "doc_id"), ["doc_id", "s1", "s2"])
    nodes = staged(chosen.select(F.col("doc_id").alias("node"), "n_shingles", "s1", "registers").dropDuplicates(["node"]), "nodes")

    bands = _banded(nodes, setup)
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = staged(bands.join(shared, "key").distinct(), "buckets")
    full = staged(_full_sets(docs, nodes.select("node", "s1").join(buckets, "node", "left_semi"), setup), "sets")

    own = _own_shingles(full).where(100 * (F.col("size") - F.col("own")) >= setup.percent * F.col("size"))
    buckets = staged(buckets.join(own, "node"), "buckets")

    links = docs.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}")
    tested, labels = links, links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    keys = buckets.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    buckets = buckets.withColumn("apart", F.lit(None).cast("long")).withColumn("unlike", F.lit(None).cast("array<int>"))
    for turn in range(setup.star_rounds + 1):
        placed = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if turn < setup.star_rounds:
            share = F.col("own") / F.col("size")
            order = [share, "node"] if not turn else [F.floor(20 * share), F.xxhash64("node", F.lit(turn)), "node"]
            centre = F.min(F.struct(*[F.col(x).alias(f"_{k}") if isinstance(x, str) else x.alias(f"_{k}") for k, x in enumerate(order)], "node", "comp", "size", "own", "apart", "unlike"))
            other = placed.groupBy("key").agg(centre.alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "c.node", "c.comp", "c.size", "c.own", "c.apart", "c.unlike")
        else:
            sizes = placed.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("large"), F.count("*").alias("parts"))
            placed = placed.join(sizes.where("parts > 1").select("key", F.col("large.comp").alias("main")), "key")
            placed = placed.join(keys, "node")
            other = placed.where("comp <> main")
        meet = (F.col("p.key") == F.col("o.key")) & (F.col("p.comp") != F.col("o.comp")) & _may_link(setup.percent)
        if turn == setup.star_rounds:
            # In the first bucket only of those that both are in.
            meet = meet & (F.array_intersect("p.keys", "o.keys")[0] == F.col("p.key"))
        met = placed.alias("p").join(other.alias("o"), meet).select(F.least("p.node", "o.node").alias("a"), F.greatest("p.node", "o.node").alias("b"))
        pairs = staged(met.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        checked = staged(_linked(staged(_likely(pairs, nodes, setup), "likely"), full, setup, 0 if turn else setup.cells), "checked")
        links = links.union(checked.where("linked").select("a", "b"))
        labels = components(links)
        if not turn:
            buckets = staged(_with_distances(buckets, other.select("key", F.col("node").alias("centre")), checked, labels, setup.cells), "buckets")

    reached = members.select("doc_id", "node").distinct().join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "node")).alias("component_id"))
    found = every.select("doc_id", "n_shingles").join(reached, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
