"""A Bloom filter of the hashes that occur with two different owners, as a first sieve of candidates.

Each task sends the distinct hashes of some megabytes of text to buckets, with the smallest and the largest owner of each;
the task that owns a bucket fills the filter's segment with the hashes of two owners. So a hash that is everywhere is one
entry for each group of texts. The filter has at most FILTER_BITS bits: what comes through wrongly costs work later and
changes no result, and nothing that is shared is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gopmill.llm.textarrays import SLICE_BYTES, U64, Bloom, Texts, bucket_edges, packed, slices, unpacked

FLUSH_BYTES = 12 << 20
FILTER_BITS = 1 << 28
BITS_PER_HASH = 12
KEPT_BITS = 44
CUT = U64(64 - KEPT_BITS)


def passes(bloom: Bloom, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter holds."""
    return bloom.holds(h >> CUT << CUT)


def _gather(buckets: int, owned: Callable[[pa.RecordBatch, Texts], tuple[np.ndarray, np.ndarray]], piece: int):
    def flush(hashes, owners) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        h >>= CUT
        order = np.argsort(h)
        h, owner = h[order], np.concatenate(owners)[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
        if not len(first):
            return
        low, high, u = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first), h[first]
        edges = bucket_edges(u << CUT, buckets)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            rows.append((b, packed(np.diff(u[part], prepend=U64(0)), low[part], (high - low)[part])))
        for at in range(0, len(rows), 64):
            columns = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["bucket", "blob"])

    def run(batches):
        held, size = ([], []), 0
        for batch, texts in slices(batches, limit=piece):
            for kept, new in zip(held, owned(batch, texts), strict=True):
                kept.append(new)
            size += len(texts.data)
            if size >= FLUSH_BYTES:
                yield from flush(*held)
                held, size = ([], []), 0
        if size:
            yield from flush(*held)

    return run


def _segment(buckets: int):
    most = FILTER_BITS // buckets

    def run(table: pa.Table) -> pa.Table:
        blobs = [unpacked(b) for b in table.column("blob").to_pylist()]
        h = np.concatenate([np.cumsum(x[0], dtype=U64) for x in blobs]) << CUT
        low = np.concatenate([x[1] for x in blobs])
        high = low + np.concatenate([x[2] for x in blobs])
        order = np.argsort(h)
        h, low, high = h[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        held = h[first][np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)]
        bits = Bloom.segment(held, min(BITS_PER_HASH * len(held), most)).tobytes()
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([bits], pa.binary())})

    return run


def shared_hashes(rows: DataFrame, buckets: int, owned: Callable[[pa.RecordBatch, Texts], tuple[np.ndarray, np.ndarray]], piece: int = SLICE_BYTES):
    """The filter, broadcast. ``owned`` gives hashes and the owner (a 64-bit number) of each, for a batch with about ``piece`` bytes of ``text``."""
    blobs = rows.mapInArrow(_gather(buckets, owned, piece), "bucket int, blob binary")
    found = blobs.groupBy("bucket").applyInArrow(_segment(buckets), "bucket int, bits binary").collect()
    segments = {r.bucket: np.frombuffer(r.bits, np.uint8) for r in found}
    return rows.sparkSession.sparkContext.broadcast(Bloom([segments.get(b, np.zeros(1, np.uint8)) for b in range(buckets)]))
