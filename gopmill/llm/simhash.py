"""SimHash near-duplicates: fingerprints linked at a few differing bits, classes by reachability.

Equal fingerprints are one point first, so groups of copies, however large, are one row. Distances of 64-bit
fingerprints pile up at 32 +- 4, and against a radius of 4 a vantage point's shells overlap almost wholly: over the
whole table a vantage-point tree alone would send each point to nearly every shard (figures in the README). So
points are first split by distance zero on a few bits: of ``segments`` segments two linked points differ in at most
``bits``, so they agree on at least one choice of ``segments - bits`` of them, and are sure to meet in that shard.
Inside shards a vantage-point tree does the exact search: points within the radius of the vantage point are linked to
it, the rest is cut by distance to it, and by the triangle inequality only points within the radius of the cut on either
side are compared across. A shard larger than ``shard_rows`` is itself cut by distance to its vantage point into
shells that only meet their neighbours. Shards report a spanning forest, never all pairs.

Null texts and texts without words have the fingerprint zero and are linked like any other. A class is named by the
smallest doc_id reachable; a null id is never that name unless all are null. Repeated rows are one point.

``similar_classes`` is for near copies by similarity (0.8 or more of two texts' different five-word shingles). 64 bits tell
0.8 from 0.6 badly, so its fingerprints have 1,024 bits: of two texts with Jaccard similarity s about
1024 acos(2s / (1 + s)) / pi bits differ, 155 +- 12 at 0.8, and WIDE_BITS proposes up to 192: 999 in 1,000 pairs at 0.8.
Points within so wide a
radius agree on no segment, so shards are min-wise bands instead: two texts of similarity s share a band of BAND_ROWS
minima with probability s^5, one of ten bands with 0.98 at 0.8. Inside a shard distances to a vantage point prune the
search, classes are grown from it, and only links that join classes leave the task. A shard larger than ``shard_rows``
is cut into blocks that meet two by two, so that no task holds more than two blocks and no pair is lost.

Bits and bands only propose, and they miss some: one pair in fifty at 0.8 shares no band, and half of those of four and
five shingles differ in more than 192 bits. So classes that they make are proposed to be one by an exact way as well. In
one order of all shingles, the same for all texts and with frequent ones last, two sets of similarity 0.8 share at least
one of their first fifths; a further tenth asks for as many more shared ones, which leaves few other pairs. Which order
it is makes no difference to what is found, so a sixteenth of the rows tells which shingles are frequent.

Every class so proposed is searched a second time, now with the shingles of its texts, which are sent there once: two
texts are linked if their sets of shingles have a similarity of 0.8 or more, counted exactly. As all pairs of a class are
looked at, no link hangs on which of several proposed ones was kept, and no pair of 0.8 or more is lost.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, fresh, key, release
from gopmill.llm.textarrays import Texts, mixed, powers, slices
from gopmill.session import written

U64 = np.uint64
SHINGLE = 4
SEED = 42
BITS = 4
SEGMENTS = 5
BRUTE = 256
SHARD_ROWS = 1 << 14
SIMILAR_SHINGLE = 5
# a similarity of 0.8, as two integers
SHARED, OF_ALL = 4, 5
WIDE_WORDS = 16
WIDE_BITS = 192
BANDS = 10
BAND_ROWS = 5
WIDE_SHARD_ROWS = 1 << 15
SHARD_SHINGLES = 1 << 22
# prefixes are longer by a tenth of a set, of which as many have to be shared
FURTHER = 10
# a shingle is frequent if this many of the sampled rows have it, one row in SAMPLED; the most frequent ones are known
FREQUENT, SAMPLED, MOST_FREQUENT = 16, 16, 1 << 20
PREFIX_BLOCK = 1 << 10


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join, xxhash.xxh64_intdigest
    h = np.fromiter((digest(line(words[i : i + SHINGLE]), SEED) for i in range(len(words) - SHINGLE + 1)), U64, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(U64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), U64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(KEY), pa.array(prints.view(np.int64))], names=["doc_id", KEY, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row key and the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key(), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id bigint, {KEY} bigint, fp bigint")


class Forest:
    """Links that join two classes not joined before."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, a: int) -> int:
        parent = self.parent
        while parent.setdefault(a, a) != a:
            parent[a] = a = parent[parent[a]]
        return a

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.parent[q] = p
                self.links.append((x, y))


def _across(a: np.ndarray, b: np.ndarray, bits: int, forest: Forest) -> None:
    """Links between two sets of points, in blocks."""
    for at in range(0, len(a), BRUTE):
        part = a[at : at + BRUTE]
        for low in range(0, len(b), 1 << 14):
            other = b[low : low + (1 << 14)]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= bits)
            forest.link(part[i], other[j])


def tree_links(points: np.ndarray, bits: int, forest: Forest) -> None:
    """Vantage-point search of all links among distinct points, as far as they join new classes."""
    work = [points]
    while work:
        points = work.pop()
        if len(points) <= BRUTE:
            distance = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
            i, j = np.nonzero(np.triu(distance, 1))
            forest.link(points[i], points[j])
            continue
        far = np.bitwise_count(points ^ points[len(points) // 2]).astype(np.int64)
        near = points[(far <= bits) & (far > 0)]
        forest.link(np.full(len(near), points[len(points) // 2], U64), near)
        cut = int(np.median(far))
        inside, outside = points[far <= cut], points[far > cut]
        if not len(outside) or not len(inside):  # all at one distance
            _across(points, points, bits, forest)
            continue
        _across(points[(far <= cut) & (far > cut - bits)], points[(far > cut) & (far <= cut + bits)], bits, forest)
        work += [inside, outside]


def _shard_links(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key = None

        def links(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            forest = Forest()
            tree_links(fp[home], bits, forest)
            _across(fp[home], fp[~home], bits, forest)
            return forest.links

        def out(found) -> pa.RecordBatch:
            a = np.array(found, U64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            shard, fp = batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(U64)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            found = []
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if held and shard[lo] != held_key:
                    if sum(len(x[0]) for x in held) > 1:
                        found += links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held = []
                held_key = shard[lo]
                held.append((fp[lo:hi], home[lo:hi]))
            yield out(found)
        if held:
            yield out(links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))

    return run


def shard_keys(bits: int, segments: int) -> list[int]:
    """Bit masks: any two fingerprints within ``bits`` agree under at least one of them."""
    edges = [64 * i // segments for i in range(segments + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, segments - bits)]


def links(points: DataFrame, bits: int = BITS, segments: int = SEGMENTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in ``points(fp)``; every class of linked points is joined by them.

    More segments make more and smaller shards: shards hold about n / 2^(64 (segments - bits) / segments) points.
    """
    masks = shard_keys(bits, segments)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    placed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("mask", "part"))
    placed = placed.select("fp", F.xxhash64("mask", "part").alias("shard"))
    # shards too large for one task are cut into shells around a vantage point of their own
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("fp").alias("vantage"))
    large = sizes.filter(F.col("rows") > shard_rows)
    shells = placed.join(large, "shard", "left").select(
        "fp", "shard", "vantage", F.when(F.col("vantage").isNotNull(), F.bit_count(F.expr("fp ^ vantage"))).alias("shell")
    )
    ordinary = shells.filter("shell is null").select("fp", "shard", F.lit(True).alias("home"))
    # a point belongs to its shell and looks back at those within the radius; salted by fingerprint parts when still large
    cut = shells.filter("shell is not null").select(
        "fp", F.explode(F.sequence(F.col("shell"), F.col("shell") + bits)).alias("at"), "shard", "shell"
    ).select("fp", F.xxhash64("shard", "at").alias("shard"), (F.col("at") == F.col("shell")).alias("home"))
    return ordinary.unionByName(cut).repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_links(bits), "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): label is the smallest node reachable over (a, b). Each round is written, so lineage stays short.

    Every node points at the smallest node among its neighbours' pointers; pointers are then followed one step, so long
    chains halve. Nodes without links are not listed.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = written(labels)
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        # hooking: a node's present label also learns of it, so that whole classes move at once
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        roots = step.groupBy("label").agg(F.min("new").alias("root"))
        moved = step.join(roots, "label").select("node", F.col("label").alias("old"), F.least("new", "root").alias("label"))
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(moved.join(up, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label != old").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"classes not settled after {rounds} rounds")
    return labels


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, row key, fp, label and component_id of every row; label is the same in a class and never null."""
    prints = written(fingerprints(docs))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(points.select("fp"), bits))
    named = written(points.join(linked, points.fp == linked.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("fp", "label").join(smallest, "label"), "fp")


def op5(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest doc_id; columns as they came."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    name = fresh(docs, KEY)
    stay = classes(docs, bits).groupBy("label").agg(F.min_by(KEY, order).alias(name)).select(name)
    return docs.withColumn(name, key()).join(stay, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def _salts(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed))


SIGNS, MINIMA = _salts(WIDE_WORDS, 1), _salts(BANDS * BAND_ROWS, 2)


def shingle_sets(texts: Texts) -> Iterator[np.ndarray]:
    """Hashes of the different five-word shingles of each text, A-Z in lower case; of fewer words the whole sequence."""
    lower = texts.lower()
    _, start, end = lower.words()
    word = lower.hashes(start, end)
    power, inverse = powers(len(word) + 1)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * power[: len(word)], out=total[1:])
    edges = np.searchsorted(start, lower.offsets)
    for low, high in itertools.pairwise(edges.tolist()):
        size = min(SIMILAR_SHINGLE, high - low)
        first = np.arange(low, high - size + 1) if size else np.zeros(0, np.int64)
        yield np.unique(mixed((total[first + size] - total[first]) * inverse[first]))


def wide_print(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1,024 bits and the band hashes of a set of shingles; all zero for none."""
    if not len(h):
        return np.zeros(WIDE_WORDS, U64), np.zeros(BANDS, U64)
    votes, least = np.zeros(64 * WIDE_WORDS, np.int64), np.full(len(MINIMA), ~U64(0))
    for at in range(0, len(h), 1 << 10):
        part = h[at : at + (1 << 10), None]
        bits = np.unpackbits(mixed(part ^ SIGNS).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.uint16)
        least = np.minimum(least, mixed(part + MINIMA).min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    bands = np.zeros(BANDS, U64)
    for column in rows.T:
        bands = mixed(bands ^ column)
    return np.packbits(2 * votes > len(h), bitorder="little").view(U64), bands


def _node(h: np.ndarray) -> bytes:
    """The name of a set of shingles."""
    return hashlib.md5(h.tobytes(), usedforsecurity=False).digest()


def prefix(h: np.ndarray, frequent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all sets: by ``rows`` where ``frequent``, after all others, then by hash."""
    size = len(h) - -(-SHARED * len(h) // OF_ALL) + len(h) // FURTHER + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = h[np.lexsort((h, np.where(frequent[at] == h, rows[at], 0)))]
    return h[:size]


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(texts))).view(np.int64))], names=["shingle"])


def frequent_shingles(rows: DataFrame):
    """Shingles that many of ``rows(_key, text)`` have, in order, and how many of the sampled rows; broadcast."""
    some = rows.filter(F.pmod(F.col(KEY), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_sampled, "shingle bigint")
    counts = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= FREQUENT)
    found = counts.orderBy(F.col("rows").desc(), "shingle").limit(MOST_FREQUENT).toArrow()
    shingle, times = (found.column(c).to_numpy() for c in ("shingle", "rows"))
    order = np.argsort(shingle.view(U64))
    return rows.sparkSession.sparkContext.broadcast((shingle.view(U64)[order], times[order]))


def _wide_prints(frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = list(shingle_sets(texts))
            found = [wide_print(h) for h in sets]
            prints = pa.array([p.tobytes() for p, _ in found], pa.binary())
            bands = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([b for _, b in found]).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            nodes, sizes = pa.array([_node(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64())
            firsts = [prefix(h, *frequent.value).view(np.int64) for h in sets]
            edges = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(firsts)))
            columns = [batch.column("doc_id"), batch.column(KEY), nodes, sizes, prints, bands, prefixes]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", KEY, "node", "size", "print", "bands", "prefix"])

    return run


def _node_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        sets = list(shingle_sets(texts))
        columns = [pa.array([_node(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])


class ShingleSets:
    """Sets of shingles that are compared with each other, as numbers from zero."""

    def __init__(self, sets: list[np.ndarray]):
        self.edges = np.cumsum([0, *map(len, sets)])
        self.sizes = np.diff(self.edges)
        different, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(len(different), bool)
        # who has a shingle among the first fifth of a set
        self.firsts = self.sizes - -(-SHARED * self.sizes // OF_ALL) + 1
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        first = np.arange(len(owner)) < (self.edges[:-1] + self.firsts)[owner]
        self.owner = owner[first][np.argsort(self.numbers[first], kind="stable")]
        self.owned = np.concatenate([[0], np.cumsum(np.bincount(self.numbers[first], minlength=len(different)))])

    def _of(self, at: int) -> np.ndarray:
        return self.numbers[self.edges[at] : self.edges[at + 1]]

    def linked(self, a: int, open_: np.ndarray) -> np.ndarray:
        """The ``open_`` sets (a mask) similar to ``a``."""
        met = np.zeros(len(self.sizes), bool)
        for number in self._of(a)[: self.firsts[a]].tolist():
            met[self.owner[self.owned[number] : self.owned[number + 1]]] = True
        met &= open_ & (OF_ALL * self.sizes >= SHARED * self.sizes[a]) & (OF_ALL * self.sizes[a] >= SHARED * self.sizes)
        others = np.flatnonzero(met)
        return others[self.similar(a, others)] if len(others) else others

    def similar(self, a: int, others: np.ndarray) -> np.ndarray:
        """Which of the ``others`` have a similarity of 0.8 or more to ``a``."""
        own = self._of(a)
        self.marked[own] = True
        shared = np.array([np.count_nonzero(self.marked[self._of(b)]) for b in others.tolist()], np.int64)
        self.marked[own] = False
        every = len(own) + self.sizes[others] - shared
        return OF_ALL * shared >= SHARED * every


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int16)
    for word in range(WIDE_WORDS):
        out += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


def similar_sets(sets: ShingleSets) -> list[tuple[int, int]]:
    """Links of a spanning forest: all sets similar to each other are joined by them."""
    open_, found = np.ones(len(sets.sizes), bool), []
    for seed in range(len(open_)):
        if not open_[seed]:
            continue
        open_[seed] = False
        frontier = [seed]
        while frontier:
            a = frontier.pop()
            hit = sets.linked(a, open_)
            open_[hit] = False
            found += [(a, b) for b in hit.tolist()]
            frontier += hit.tolist()
    return found


def grown_links(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest: all points (n x WIDE_WORDS) within ``bits`` of each other are joined by them.

    By the triangle inequality two linked points differ by at most ``bits`` in their distance to the vantage point, so
    points sorted by it need only be compared with a window of that order.
    """
    vantage = _distances(points[:1], points)[0].astype(np.int64)
    order = np.argsort(vantage, kind="stable")
    points, far = points[order], vantage[order]
    open_, found = np.ones(len(points), bool), []
    for seed in range(len(points)):
        if not open_[seed]:
            continue
        open_[seed] = False
        frontier = np.array([seed])
        while len(frontier):
            part, frontier = frontier[:64], frontier[64:]
            low, high = np.searchsorted(far, far[part].min() - bits), np.searchsorted(far, far[part].max() + bits, side="right")
            left = low + np.flatnonzero(open_[low:high])
            for at in range(0, len(left), 1 << 13):
                some = left[at : at + (1 << 13)]
                close = _distances(points[part], points[some]) <= bits
                for row in np.flatnonzero(close.any(1)):
                    hit = some[close[row] & open_[some]]
                    found += [(int(order[part[row]]), b) for b in order[hit].tolist()]
                    open_[hit] = False
                    frontier = np.concatenate([frontier, hit])
    return found


def _near_prints(bits: int):
    return lambda held: grown_links(np.frombuffer(b"".join(held), U64).reshape(-1, WIDE_WORDS), bits)


def _near_sets(held: list[bytes]) -> list[tuple[int, int]]:
    return similar_sets(ShingleSets([np.frombuffer(h, U64) for h in held]))


def _wide_shards(column: str, links: Callable[[list[bytes]], list[tuple[int, int]]]):
    """The ``links`` of the values in ``column`` of each shard, by the names of its nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        held_shard = None

        def out() -> pa.RecordBatch:
            pairs = links([value for _, value in held])
            columns = [pa.array([held[pair[side]][0] for pair in pairs], pa.binary()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "node", column)), strict=True):
                if shard != held_shard:
                    if len(held) > 1:
                        yield out()
                    held, held_shard = [], shard
                held.append(tuple(row))
        if len(held) > 1:
            yield out()

    return run


def _shards(placed: DataFrame, shard_rows: int, shard_shingles: int | None = None) -> DataFrame:
    """(node, shard) such that any two nodes of a group in ``placed(node, size, part)`` meet in a shard."""
    count = F.ceil(2 * F.col("rows") / F.lit(shard_rows)).cast("int")
    fits = F.col("rows") <= shard_rows
    if shard_shingles is not None:
        count = F.greatest(count, F.ceil(2 * F.col("sizes") / F.lit(shard_shingles)).cast("int"))
        fits = fits & (F.col("sizes") <= shard_shingles)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("sizes")).filter("rows > 1")
    # blocks of half a shard; a block alone if there is one, else every two blocks meet in a shard
    met = placed.select("node", "part").join(sizes.select("part", F.when(fits, 1).otherwise(count).alias("blocks")), "part")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    each = met.select("node", "part", "blocks", own.alias("own"), F.explode(other).alias("other")).filter("blocks = 1 or own != other")
    shard = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))
    return each.select("node", shard.alias("shard"))


def similar_links(points: DataFrame, bits: int = WIDE_BITS, shard_rows: int = WIDE_SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) of ``points(node, size, print, bands)``, distinct by node, that share a band and are within ``bits``."""
    placed = points.select("node", "size", F.posexplode("bands").alias("band", "part"))
    sent = _shards(placed.select("node", "size", F.xxhash64("band", "part").alias("part")), shard_rows).join(points.select("node", "print"), "node")
    return sent.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_wide_shards("print", _near_prints(bits)), "a binary, b binary")


def shared_prefixes(prints: DataFrame, named: DataFrame, block: int = PREFIX_BLOCK) -> DataFrame:
    """Pairs (a, b) of different tags of ``named(id, tag, size)`` of which two sets may be similar by ``prints(id, prefix)``.

    Of two sets of m and n shingles, m the smaller, that are similar, 4/9 (m + n) are shared. So the first k shared ones in
    the order of all sets are among the first m + k - 4/9 (m + n) of one and n + k - 4/9 (m + n) of the other, for any k; it is
    a tenth of m and one more. A shingle of very many sets is cut into blocks of them, every one of which meets every one.
    """
    each = Window.partitionBy("shingle")

    def several(rows: DataFrame, owner: str) -> DataFrame:
        ends = [F.min(owner).over(each).alias("low"), F.max(owner).over(each).alias("high")]
        return rows.select("*", *ends).filter("low != high").drop("low", "high")

    posted = prints.select("id", F.posexplode("prefix").alias("pos", "shingle"))
    # few shingles are left here; copies of a row, which come with equal ids, are one
    left = written(several(posted, "id").distinct())
    met = several(release(left).join(named, "id"), "tag")
    blocks = F.ceil(F.count(F.lit(1)).over(each) / F.lit(block))
    met = written(met.select("id", "tag", "size", "pos", "shingle", blocks.alias("blocks")))
    own, other = F.pmod("id", "blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))

    def side(name: str, first: str, second: str) -> DataFrame:
        facts = [F.col(c).alias(f"{name}_{c}") for c in ("id", "tag", "size", "pos")]
        return met.select("shingle", *facts, own.alias(first), other.alias(second))

    pairs = side("a", "x", "y").join(side("b", "y", "x"), ["shingle", "x", "y"])
    every = F.col("a_size") + F.col("b_size")
    shared = F.ceil(SHARED * every / F.lit(SHARED + OF_ALL))
    pairs = pairs.withColumn("least", F.floor(F.col("a_size") / F.lit(FURTHER)) + 1).filter(
        (F.col("a_tag") != F.col("b_tag"))
        & ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_id") < F.col("b_id"))))
        & (OF_ALL * F.col("a_size") >= SHARED * F.col("b_size"))
        & (F.col("a_pos") < F.col("a_size") - shared + F.col("least"))
        & (F.col("b_pos") < F.col("b_size") - shared + F.col("least"))
    )
    found = pairs.groupBy("a_id", "b_id", "a_tag", "b_tag", "least").agg(F.count(F.lit(1)).alias("rows")).filter("rows >= least")
    return found.select(F.col("a_tag").alias("a"), F.col("b_tag").alias("b")).distinct()


def checked_links(docs: DataFrame, members: DataFrame, shard_rows: int = WIDE_SHARD_ROWS, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """Spanning links (a, b) of ``members(node, label, size, _key)`` with one label that are similar by their shingles.

    ``docs(_key, text)`` are the texts, of which a member's is that of its key.
    """
    sets = docs.join(members.select(KEY), KEY, "left_semi").select("text").mapInArrow(_node_sets, "node binary, shingles binary")
    # two texts of one key, if ever, are two nodes; copies of a row are one
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sent = _shards(members.select("node", "size", F.col("label").alias("part")), shard_rows, shard_shingles)
    sent = sent.join(members.select("node").join(sets, "node"), "node")
    return sent.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_wide_shards("shingles", _near_sets), "a binary, b binary")


def similar_classes(docs: DataFrame, bits: int = WIDE_BITS, shard_rows: int = WIDE_SHARD_ROWS) -> DataFrame:
    """doc_id, row key, node and label of every row; the label is the same in a class of near copies and never null.

    Texts without words are a class of their own. Texts whose shingles are equal are one point.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key(), "text")
    schema = f"doc_id bigint, {KEY} bigint, node binary, size bigint, print binary, bands array<bigint>, prefix array<bigint>"
    prints = written(rows.mapInArrow(_wide_prints(frequent_shingles(rows.select(KEY, "text"))), schema))
    facts = [F.first(c).alias(c) for c in ("size", "print", "bands")]
    points = written(prints.groupBy("node").agg(*facts, F.min(KEY).alias(KEY)))
    proposed = components(similar_links(points, bits, shard_rows)).withColumnRenamed("node", "near")
    tag = F.xxhash64(F.coalesce("label", "node")).alias("tag")
    named = written(points.join(proposed, points.node == F.col("near"), "left").select("node", "size", KEY, tag, F.col("near").isNotNull().alias("met")))
    known = F.xxhash64("node").alias("id")
    rest = shared_prefixes(prints.select(known, "prefix"), release(named).select(known, "tag", "size"))
    merged = components(rest).select(F.col("node").alias("tag"), "label")
    members = written(named.join(merged, "tag", "left").filter("met or label is not null").withColumn("label", F.coalesce("label", "tag")))
    linked = components(checked_links(rows.select(KEY, "text"), release(members), shard_rows)).withColumnRenamed("node", "linked")
    at = prints.select("doc_id", KEY, "node")
    return at.join(linked, at.node == F.col("linked"), "left").select("doc_id", KEY, "node", F.coalesce("label", "node").alias("label"))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies, the one with the smallest doc_id; columns as they came."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    name = fresh(docs, KEY)
    stay = similar_classes(docs).groupBy("label").agg(F.min_by(KEY, order).alias(name)).select(name)
    return docs.withColumn(name, key()).join(stay, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
