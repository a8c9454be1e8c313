"""Texts of an Arrow batch as byte arrays: words, lines and hashes of any spans, without a Python step per word.

Used inside tasks only; how rows are spread over tasks is Spark's business in the operators. Nulls count as empty
texts. A hash of a span is a polynomial in an odd base modulo 2^64, mixed, and so the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept per worker process."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for at, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[at] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Texts:
    """Bytes of several texts in a row; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._prefix: np.ndarray | None = None

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lower(self) -> Texts:
        """A-Z in lower case, every other byte as it is."""
        upper = (self.data >= 65) & (self.data <= 90)
        return Texts(self.data + (upper.view(np.uint8) << 5), self.offsets)

    def text_of_byte(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes in each text: text, start, end."""
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        first = np.flatnonzero(starts)
        return self.text_of_byte(first), first, np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than space and 0x09-0x0D."""
        return self._spans(~self.blank())

    def blank(self) -> np.ndarray:
        return (self.data == 32) | ((self.data >= 9) & (self.data <= 13))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines cut at \\n, empty ones included: text, start, end."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        text = np.repeat(np.arange(len(self.offsets) - 1), np.bincount(self.text_of_byte(breaks), minlength=len(self.offsets) - 1) + 1)
        return text, starts, ends

    def hashes(self, start: np.ndarray, end: np.ndarray, raw: bool = False) -> np.ndarray:
        """64-bit hash of each span."""
        n = len(self.data)
        _, inverse = powers(n + 1)
        prefix = self._prefixes()
        h = (prefix[end] - prefix[start]) * inverse[start]
        return h if raw else mixed(h)

    def windows(self, size: int) -> np.ndarray:
        """64-bit hash of the ``size`` bytes from each place on; its upper bits are the mixed ones."""
        prefix = self._prefixes()
        h = prefix[size:] - prefix[: len(prefix) - size]
        h *= powers(len(prefix))[1][: len(h)]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        return h

    def _prefixes(self) -> np.ndarray:
        n = len(self.data)
        if self._prefix is None:
            each = self.data.astype(U64)
            each += U64(1)
            each *= powers(n + 1)[0][:n]
            self._prefix = np.zeros(n + 1, U64)
            np.cumsum(each, out=self._prefix[1:])
        return self._prefix

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def column_texts(column: pa.Array) -> Texts:
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches cut so that each piece holds about ``limit`` bytes of text; one longer text is a piece alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = column_texts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            low, high = texts.offsets[at], texts.offsets[to]
            yield batch.slice(at, to - at), Texts(texts.data[low:high], texts.offsets[at : to + 1] - low)
            at = to


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes. 64-bit ones are cut into byte planes, so that small numbers take little room."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        each = a.view(np.uint8).reshape(-1, a.itemsize)
        planes = np.empty((a.itemsize, len(a)), np.uint8)
        for i, plane in enumerate(planes):
            plane[:] = each[:, i]
        parts.append(np.array([ord(a.dtype.char), len(a)], np.int64).tobytes() + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        char, n = np.frombuffer(raw, np.int64, 2, at)
        kind = np.dtype(chr(char))
        at += 16
        each = np.empty((n, kind.itemsize), np.uint8)
        for i, plane in enumerate(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)):
            each[:, i] = plane
        out.append(each.view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash by its upper bits, so that sorted hashes have sorted buckets."""
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(buckets_of(sorted_hashes, buckets), np.arange(buckets + 1))


class Bloom:
    """A Bloom filter made of one segment per bucket, so that tasks that own buckets fill it side by side."""

    PROBES = 4

    def __init__(self, segments: list[np.ndarray]):
        self.bits = np.concatenate(segments)
        sizes = np.array([len(s) for s in segments], np.int64)
        self.start = (np.cumsum(sizes) - sizes).astype(U64) * U64(8)
        self.size = sizes.astype(U64) * U64(8)

    @classmethod
    def segment(cls, h: np.ndarray, bits: int) -> np.ndarray:
        """Bytes of a segment of about ``bits`` bits that holds the hashes."""
        size = U64(max(8, bits // 8) * 8)
        flags = np.zeros(int(size), np.uint8)
        for probe in range(cls.PROBES):
            flags[cls._place(h, probe, size)] = 1
        return np.packbits(flags, bitorder="little")

    @staticmethod
    def _place(h: np.ndarray, probe: int, size) -> np.ndarray:
        return (mixed(h + U64((probe + 1) * 0x632BE59BD9B4E019 % 2**64)) >> U64(16)) % size

    def holds(self, h: np.ndarray) -> np.ndarray:
        bucket = buckets_of(h, len(self.size)).astype(np.int64)
        size, start = self.size[bucket], self.start[bucket]
        at, left = np.arange(len(h)), np.ones(len(h), bool)
        for probe in range(self.PROBES):
            bit = start[at] + self._place(h[at], probe, size[at])
            seen = (self.bits[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1
            left[at[~seen]] = False
            at = at[seen]
        return left
