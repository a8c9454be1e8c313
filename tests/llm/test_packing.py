import itertools

import numpy as np
import pytest
from conftest import with_clashes

from gopmill.llm import packing


def padding(lengths, counts, edges):
    total, low = 0, -1
    for edge in edges:
        total += sum(c * (edge - n) for n, c in zip(lengths, counts, strict=True) if low < n <= edge)
        low = edge
    return total


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 60, 11))
    counts = rng.integers(1, 30, len(lengths))
    for buckets in (1, 2, 3, 5, 20):
        got = packing.boundaries(lengths, counts, buckets)
        assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= buckets
        k = min(buckets, len(lengths))
        best = min(padding(lengths, counts, [*c, int(lengths[-1])]) for c in itertools.combinations(lengths[:-1].tolist(), k - 1))
        assert padding(lengths, counts, got) == best


def check(rows, docs, buckets, budget):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs)
    sizes = sorted(len((r.text or "").encode().split()) for r in docs)
    assert sorted(r.n_tokens for r in rows) == sizes
    batches = {}
    for r in rows:
        assert 0 <= r.padding == r.boundary - r.n_tokens
        batches.setdefault(r.batch, []).append(r)
    for held in batches.values():
        assert len({r.boundary for r in held}) == 1 and sorted(r.slot for r in held) == list(range(len(held)))
        assert len(held) == 1 or len(held) * held[0].boundary <= budget
    assert len({r.boundary for r in rows}) <= buckets
    return batches


def test_batches_hold_every_text_once(docs):
    data = docs.collect()
    rows = packing.pack(with_clashes(docs), 8, 4096).collect()
    check(rows, data, 8, 4096)
    lengths, counts = np.unique([len((r.text or "").encode().split()) for r in data], return_counts=True)
    if data:
        assert sum(r.padding for r in rows) == padding(lengths, counts, packing.boundaries(lengths, counts, 8))


def test_shards_and_rounded_lengths(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    monkeypatch.setattr(packing, "MAX_BINS", 50)
    monkeypatch.setattr(packing, "EXACT_BELOW", 64)
    data = small.collect()
    batches = check(packing.pack(small, 4, 2000).collect(), data, 4, 2000)
    per_bucket = {}
    for name, held in batches.items():
        bucket, shard, _ = name.split("-")
        per_bucket.setdefault((bucket, shard), []).append((len(held), max(1, 2000 // max(held[0].boundary, 1))))
    assert all(sum(n < most for n, most in v) <= 1 for v in per_bucket.values())


def test_boundaries_are_optimal_for_many_lengths():
    rng = np.random.default_rng(9)
    lengths = np.unique(rng.integers(0, 20000, 700))
    counts = rng.integers(1, 1000, len(lengths))
    texts = np.concatenate([[0], np.cumsum(counts)])
    best = np.concatenate([[0], np.full(len(lengths), 1 << 60)])
    for _ in range(16):
        best = np.array([0, *(int(min(best[:j] + lengths[j - 1] * (texts[j] - texts[:j]))) for j in range(1, len(lengths) + 1))])
    got = packing.boundaries(lengths, counts, 16)
    assert padding(lengths, counts, got) == best[-1] - int((lengths * counts).sum())


def test_padding_is_least_with_more_lengths_than_the_former_bound(small, monkeypatch):
    monkeypatch.setattr(packing, "MAX_BINS", 20, raising=False)
    monkeypatch.setattr(packing, "EXACT_BELOW", 64, raising=False)
    rows = packing.pack(small, 4, 2000).collect()
    lengths, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    assert {r.boundary for r in rows} <= set(lengths.tolist())
    assert sum(r.padding for r in rows) == padding(lengths, counts, packing.boundaries(lengths, counts, 4))
