"""Removes bytes covered by a 50-byte string that also starts in a document with a smaller id.

Which strings are equal is decided on a Burrows-Wheeler transform by threshold-bounded interval expansion. Starting
from the intervals of the last bytes of all candidate strings, each round extends every interval backwards by two
bytes, so rounds are common prefixes of increasing length; intervals of one document are dropped, and at the minimum
length the intervals left are the repeated strings.

How it is spread: each 50-byte string has an anchor, the 32-byte piece inside it with the smallest hash, so equal
strings have equal anchors and meet in the same bucket. Neighbouring strings mostly share their anchor and travel
as one stretch of text. First the anchors of all texts are counted by bucket; those that occur in two documents go to a
Bloom filter of bounded size, which only spares work: a false positive costs a little text, nothing is lost. Then the
stretches around shared anchors go to their buckets, each distinct stretch once a task with the smallest doc_id it
has, so a passage in every document is one row per task. A stretch alone with its anchor has no string in common with
another, so its smallest and largest doc_id decide it; the others of a bucket are worked through in chunks of about a megabyte.
The verdict on each distinct stretch (the first document of each of its strings) is joined back to its occurrences,
a many-to-one join that Spark may split on hot stretches.

Null texts are empty. A document without an id is never smaller or larger than another: nothing is removed from it and
it removes nothing. Rows with the same doc_id are not smaller than each other, so repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, bucket_count, key, release
from gopmill.llm.sharedfilter import passes, shared_hashes
from gopmill.llm.textarrays import U64, Bloom, Texts, bucket_edges, column_texts, mixed, packed, slices, unpacked
from gopmill.session import written

LENGTH = 50
ANCHOR = 32
WINDOW = LENGTH - ANCHOR + 1
BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 12 << 20
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 18  # hashes of that much text stay in a core's cache
PAD = np.zeros(LENGTH + WINDOW - 1, np.uint8)  # as long as the longest stretch
SIZE_BITS = 7  # for the size of a removed range, which lies in one stretch
NOWHERE = np.iinfo(np.int64).max
ORDER = 14  # bytes by which the transform's suffixes are sorted; deeper intervals are told apart as they grow


def _least(texts: Texts) -> np.ndarray:
    """For each place the smallest hash of an anchor in the 50 bytes from there on."""
    h = texts.windows(ANCHOR)
    other, span = np.empty_like(h), 1
    while span * 2 <= WINDOW:
        h, other = np.minimum(h[:-span], h[span:], out=other[: len(h) - span]), h
        span *= 2
    n = len(texts.data) - LENGTH + 1
    return np.minimum(h[:n], h[WINDOW - span : WINDOW - span + n], out=other[:n])


def stretches(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start, number of neighbouring 50-byte strings with that anchor, and their text."""
    none = np.zeros(0, np.int64)
    if len(texts.data) < LENGTH:
        return none.astype(U64), none, none, none
    least = _least(texts)
    begins = np.empty(len(least), bool)
    begins[0] = True
    np.not_equal(least[1:], least[:-1], out=begins[1:])
    begins[texts.offsets[:-1][texts.lengths >= LENGTH]] = True
    first = np.flatnonzero(begins)
    # strings lie inside one text
    size = np.diff(np.searchsorted(first, texts.offsets))
    row = np.repeat(np.arange(len(size)), size)
    count = np.minimum(np.append(first[1:], len(least)), texts.offsets[1:][row] - LENGTH + 1) - first
    inside = count > 0
    first, count, row = first[inside], count[inside], row[inside]
    # a stretch holds one occurrence of its anchor: at most as many strings as there are places for it
    extra = (count - 1) // WINDOW
    if extra.any():
        step = np.arange(extra.sum() + len(extra)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        first, row = np.repeat(first, extra + 1) + step * WINDOW, np.repeat(row, extra + 1)
        count = np.minimum(np.repeat(count, extra + 1) - step * WINDOW, WINDOW)
    # smallest hashes are small numbers: mixed again, they fill the buckets evenly
    return mixed(least[first] + U64(1)), first, count, row


def _anchors(batch: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, row = stretches(texts)
    return h, batch.column("doc_id").to_numpy()[row]


def _candidates(texts: Texts, bloom: Bloom):
    found = stretches(texts)
    keep = passes(bloom, found[0])
    h, first, count, row = (x[keep] for x in found)
    return h, first, count, row, texts.hashes(first, first + count + LENGTH - 1)


def _stretches(buckets: int, bloom):
    """Distinct stretches of each task by bucket: anchor, hash, number of strings, smallest id, text."""

    def flush(parts) -> Iterator[pa.RecordBatch]:
        anchor, name, count, doc, starts = (np.concatenate([p[i] for p in parts]) for i in range(5))
        data = np.concatenate([p[5] for p in parts] + [PAD])
        if not len(anchor):
            return
        first, low, high = _distinct(anchor, name, doc, doc)
        edges = bucket_edges(anchor[first], buckets)
        rows = []
        for b in range(buckets):
            part = slice(edges[b], edges[b + 1])
            own = first[part]
            if len(own):
                rows.append((b, packed(np.diff(anchor[own], prepend=U64(0)), count[own].astype(np.int8), low[part], (high - low)[part], _bodies(data, starts[own], count[own]))))
        for at in range(0, len(rows), 64):
            part = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary())], names=["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for batch, texts in slices(batches, limit=PIECE_BYTES):
            anchor, first, count, row, name = _candidates(texts, bloom.value)
            held.append((anchor, name, count, batch.column("doc_id").to_numpy()[row], first + size, texts.data.copy()))
            size += len(texts.data)
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _names(body: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of stretches that lie one after another."""
    ends = np.cumsum(count.astype(np.int64) + LENGTH - 1)
    starts = np.concatenate([[0], ends[:-1]])
    return Texts(body, np.array([0, len(body)])).hashes(starts, ends)


def _distinct(anchor: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One index per distinct stretch, in the order of anchors, with the smallest and the largest id over its rows."""
    order = np.argsort(anchor)
    # only rows whose anchor has others are sorted by name
    new = np.concatenate([[True], anchor[order[1:]] != anchor[order[:-1]], [True]])
    several = np.flatnonzero(~(new[:-1] & new[1:]))
    group = np.cumsum(new[:-1])[several]
    order[several] = order[several][np.lexsort((name[order[several]], group))]
    a, s = anchor[order], name[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
    return order[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _bodies(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bytes of stretches one after another, from data that ends with PAD."""
    rows = np.ndarray(len(data) - len(PAD) + 1, f"V{len(PAD)}", data, strides=(1,))[start]
    return rows.view(np.uint8).reshape(-1, len(PAD))[np.arange(len(PAD)) < (count + LENGTH - 1)[:, None]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start[i], ..., start[i] + size[i] - 1 of all i in a row."""
    shift = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(shift - start, size)


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` bytes at least, and each position's place in that order."""
    n = len(data)
    # eight bytes from each position on, as a number; after the end there are zeros
    rank = np.ndarray(n, ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(U64)
    known = 8
    while True:
        order = np.argsort(rank)
        sorted_rank = rank[order]
        fresh = np.zeros(n, np.int64)
        np.cumsum(sorted_rank[1:] != sorted_rank[:-1], out=fresh[1:])
        if known >= depth or fresh[-1] == n - 1:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        rank = np.empty(n, U64)
        rank[order] = fresh.astype(U64) + U64(1)
        ahead = np.zeros(n, U64)
        ahead[: max(n - known, 0)] = rank[known:]
        rank = rank * U64(n + 2) + ahead
        known *= 2


def _numbered(breaks: np.ndarray) -> np.ndarray:
    """Number of the run each place is in, from the places where a new one starts."""
    out = np.zeros(len(breaks) + 1, np.int32)
    np.cumsum(breaks, out=out[1:])
    return out


def repeated_strings(data: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of ``length`` bytes that end before ``ends``, those found in two documents: (index, smallest id).

    ``low`` and ``high`` are the smallest and the largest id that each string stands for.

    ``transform[i]`` is the byte before the i-th suffix, ``back[i]`` the place of the suffix one byte longer. An
    interval is a run of places whose suffixes share their first bytes; extending it backwards splits it by
    ``transform`` and moves it to ``back``. Only places that some string passes through are followed. A string alone in
    its interval equals no other: it is found if it stands for two documents, and ends there.
    """
    order, place = suffix_order(data, ORDER)
    transform, back = data[order - 1], place[order - 1].astype(np.int32)
    two_back = back[back]
    two = transform[back].astype(np.uint16) << 8 | transform
    at = np.sort(place[ends - 1]).astype(np.int32)
    string = np.empty(len(data), np.int32)  # the string whose suffix stands at a place; there is one, ends differ
    string[place[ends - 1]] = np.arange(len(ends))
    who = string[at]
    first = data[order[at]]
    interval = _numbered(first[1:] != first[:-1]) if len(at) else at
    known = 1
    found = [(who[:0], low[:0])]
    while len(at):
        # intervals of one document and of one string end here
        starts = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        smallest = np.minimum.reduceat(low[who], starts)
        many = smallest != np.maximum.reduceat(high[who], starts)
        size = np.diff(np.concatenate([starts, [len(at)]]))
        if known == length:
            keep = np.repeat(many, size)
            found.append((who[keep], np.repeat(smallest, size)[keep]))
            break
        alone = many & (size == 1)
        found.append((who[starts[alone]], smallest[alone]))
        keep = np.repeat(many & ~alone, size)
        at, who, interval = at[keep], who[keep], interval[keep]
        # two bytes backwards, one at the end: a stable sort by them leaves the order of the intervals
        step = min(2, length - known)
        byte, back_to = (two[at], two_back) if step == 2 else (transform[at], back)
        turn = np.argsort(byte, kind="stable")
        at, who, byte, old = back_to[at][turn], who[turn], byte[turn], interval[turn]
        interval = _numbered((byte[1:] != byte[:-1]) | (old[1:] != old[:-1])) if len(at) else at
        known += step
    index, smallest = zip(*found, strict=True)
    return np.concatenate(index), np.concatenate(smallest)


def _verdicts(table: pa.Table) -> pa.Table:
    """One bucket: for each distinct stretch the smallest document of each of its strings, null if there is one document."""
    blobs = [unpacked(b) for b in table.column("blob").to_pylist()]
    anchor = np.concatenate([np.cumsum(x[0], dtype=U64) for x in blobs])
    count, low_id, gap = (np.concatenate([x[i] for x in blobs]) for i in (1, 2, 3))
    body = np.concatenate([x[4] for x in blobs] + [PAD])
    count = count.astype(np.int64)
    starts = np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
    name = np.concatenate([_names(x[4], x[1]) for x in blobs])
    order, least, most = _distinct(anchor, name, low_id, low_id + gap)
    a = anchor[order]
    new = np.concatenate([[True], a[1:] != a[:-1], [True]])
    # a stretch alone with its anchor has no string in common with another: its documents are those of all its strings
    alone = new[:-1] & new[1:]
    lone = alone & (least != most)
    out = [_rows(anchor[order[lone]], name[order[lone]], count[order[lone]], least[lone], np.ones(lone.sum(), np.int64))]
    order, least, most, a = order[~alone], least[~alone], most[~alone], a[~alone]
    # chunks end where an anchor ends
    group = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else order
    grown = np.cumsum(count[order] + LENGTH - 1)
    low = 0
    while low < len(order):
        limit = (grown[low - 1] if low else 0) + CHUNK_BYTES
        later = group[np.searchsorted(group, max(np.searchsorted(grown, limit), low + 1)) :]
        high = int(later[0]) if len(later) else len(order)
        own = order[low:high]
        held = count[own]
        data = _bodies(body, starts[own], held)
        begin = np.cumsum(held + LENGTH - 1) - held - LENGTH + 1
        at = _ranges(begin, held)
        index, smallest = repeated_strings(data, at + LENGTH, np.repeat(least[low:high], held), np.repeat(most[low:high], held), LENGTH)
        firsts = np.full(len(at), NOWHERE)
        firsts[index] = smallest
        edges = np.cumsum(held) - held
        lowest, highest = np.minimum.reduceat(firsts, edges), np.maximum.reduceat(firsts, edges)
        some, even = lowest != NOWHERE, lowest == highest
        kept = np.repeat(some & ~even, held)
        kept[edges[some & even]] = True
        out.append(_rows(anchor[own][some], name[own][some], held[some], firsts[kept], np.where(even, 1, held)[some]))
        low = high
    return pa.concat_tables(out)


def _rows(anchor: np.ndarray, name: np.ndarray, count: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Verdicts; ``firsts`` of a stretch is one number if its strings agree."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(firsts))
    return pa.table({"anchor": _short(anchor), "name": name.view(np.int64), "count": count.astype(np.int8), "firsts": lists})


def _short(anchor: np.ndarray) -> pa.Array:
    """32 bits of the anchor's hash: with the stretch's own hash, the 96 bits by which occurrences meet verdicts."""
    return pa.array((anchor >> U64(32)).astype(np.uint32).view(np.int32))


def _occurrences(bloom):
    def run(batches):
        for batch, texts in slices(batches, limit=PIECE_BYTES):
            anchor, first, count, row, name = _candidates(texts, bloom.value)
            yield pa.RecordBatch.from_arrays(
                [_short(anchor), pa.array(name.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column(KEY).take(pa.array(row)), pa.array(first - texts.offsets[row], pa.int32())],
                names=["anchor", "name", "doc_id", KEY, "start"],
            )

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges of each occurrence, start and size in one number: the runs of its strings that start in a smaller document."""
    for batch in batches:
        lists = batch.column("firsts")
        offsets = lists.offsets.to_numpy()
        count, size = batch.column("count").to_numpy().astype(np.int64), np.diff(offsets)
        start, doc = batch.column("start").to_numpy().astype(np.int64), batch.column("doc_id").to_numpy()
        firsts = lists.values.to_numpy()
        # strings that agree go or stay together
        whole = np.flatnonzero((size == 1) & (firsts[offsets[:-1]] < doc))
        apart = np.flatnonzero(size > 1)
        row = np.repeat(apart, size[apart])
        gone = firsts[_ranges(offsets[apart], size[apart])] < doc[row]
        at = _ranges(start[apart], size[apart])
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
        ends[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(KEY).take(pa.array(np.concatenate([whole, row[b]]))),
                pa.array(np.concatenate([start[whole] << SIZE_BITS | (count[whole] + LENGTH - 1), at[b] << SIZE_BITS | (at[e] - at[b] + LENGTH)])),
            ],
            names=[KEY, "range"],
        )


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(row key, range): byte ranges to remove, possibly overlapping."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key(), "text").filter("doc_id is not null")
    buckets = bucket_count(docs, BUCKET_BYTES)
    bloom = shared_hashes(rows.select("doc_id", "text"), buckets, _anchors, PIECE_BYTES)
    verdicts = release(written(_judged(release(rows), buckets, bloom)))
    found = rows.mapInArrow(_occurrences(bloom), f"anchor int, name bigint, doc_id bigint, {KEY} bigint, start int")
    met = found.join(verdicts, ["anchor", "name"]).filter("size(firsts) > 1 or firsts[0] < doc_id").select("doc_id", KEY, "start", "count", "firsts")
    return release(written(met.mapInArrow(_runs, f"{KEY} bigint, range bigint")))


def _judged(rows: DataFrame, buckets: int, bloom) -> DataFrame:
    """(anchor, name, count, firsts) of the distinct stretches that hold a string of two documents."""
    blobs = rows.select("doc_id", "text").mapInArrow(_stretches(buckets, bloom), "bucket int, blob binary")
    return blobs.groupBy("bucket").applyInArrow(_verdicts, "anchor int, name bigint, count tinyint, firsts array<bigint>")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column_texts(batch.column("text"))
        start, end, row = _merged(batch.column("ranges"))
        n = batch.num_rows
        removed, spans = np.zeros(n, np.int64), np.bincount(row, minlength=n)
        np.add.at(removed, row, end - start)
        data, base = memoryview(texts.data), texts.offsets[row]
        start, end, edges = (base + start).tolist(), (base + end).tolist(), np.concatenate([[0], np.cumsum(spans)]).tolist()
        offsets, digests = texts.offsets.tolist(), []
        for i in range(n):
            kept, at = hashlib.sha256(), offsets[i]
            for k in range(edges[i], edges[i + 1]):
                kept.update(data[at : start[k]])
                at = end[k]
            kept.update(data[at : offsets[i + 1]])
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts.lengths), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _merged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of ranges that are sorted in each row."""
    row = pc.list_parent_indices(lists).to_numpy()
    held = lists.flatten().to_numpy()
    shift = row << 40
    start = (held >> SIZE_BITS) + shift
    end = start + (held & (1 << SIZE_BITS) - 1)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(row) else row
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return start[first] - shift[first], reach[last] - shift[first], row[first]


def op8(docs: DataFrame) -> DataFrame:
    # a set: rows equal in id and text give the same ranges
    ranges = repeated_ranges(docs).groupBy(KEY).agg(F.array_sort(F.collect_set("range")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key())
    return rows.join(ranges, KEY, "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
