import hashlib

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from conftest import with_clashes
from fixtures import frame, prose, rows

from gopmill.llm import suffix_dedup


def brute(data):
    first = {}
    for doc, text in data:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - 49):
                s = raw[i : i + 50]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < doc:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(doc), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(docs):
    return sorted((str(r.doc_id), *r[1:]) for r in suffix_dedup.op8(docs).collect())


def test_against_brute_force(docs):
    assert got(with_clashes(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_at_any_place_and_length(spark):
    passage = prose(60, 11)
    texts = [prose(50, i) + " " + passage[i : 49 + 3 * i] + " " + prose(50, 100 + i) for i in range(30)]
    texts += [passage, passage[:49], passage[:50], "ab" * 200, "ab" * 30, "é" * 40, "é" * 25]
    data = rows(*texts)
    assert got(frame(spark, data)) == brute([(r[0], r[1]) for r in data])


def test_intervals_find_what_sorting_finds():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    ends = np.arange(12, 4001)
    owner = ends % 7
    index, low = suffix_dedup.repeated_strings(data, ends, owner, owner, 12)
    seen = {}
    for e, o in zip(ends, owner, strict=True):
        seen.setdefault(bytes(data[e - 12 : e]), set()).add(int(o))
    want = {i: min(s) for i, (e, _) in enumerate(zip(ends, owner, strict=True)) if len(s := seen[bytes(data[e - 12 : e])]) > 1}
    assert dict(zip(index.tolist(), low.tolist(), strict=True)) == want


def judged(texts):
    """The verdicts of one bucket on texts numbered from 0, every anchor being a candidate."""
    everything = SimpleNamespace(value=SimpleNamespace(holds=lambda h: np.ones(len(h), bool)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    blobs = pa.Table.from_batches(suffix_dedup._stretches(1, everything)([batch]))
    return suffix_dedup._verdicts(blobs).to_pylist()


def test_a_stretch_alone_with_its_anchor_skips_the_transform(monkeypatch):
    asked = []
    whole = suffix_dedup.repeated_strings
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda data, *a: asked.append(len(data)) or whole(data, *a))
    passage = prose(400, 21)
    found = judged([prose(300, 22), passage, prose(300, 23), passage])
    assert not asked
    assert found and all(r["firsts"] == [1] for r in found)
    assert sum(r["count"] for r in found) == len(passage) - 49


def test_strings_of_a_stretch_that_differ_keep_their_own_documents():
    passage = prose(60, 31)
    texts = [passage, prose(40, 32) + passage[: len(passage) // 2] + prose(40, 33), prose(40, 34) + passage[9:] + prose(40, 35)]
    found = judged(texts)
    assert {len(r["firsts"]) == 1 for r in found} == {True, False}
    assert all(len(r["firsts"]) in (1, r["count"]) for r in found)
    assert {n for r in found for n in r["firsts"]} - {suffix_dedup.NOWHERE} == {0}


def test_strings_alone_in_an_interval_end_there(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    ends = np.arange(50, 20_001)
    sizes = []
    stable = np.argsort
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda a, **k: sizes.append(len(a)) or stable(a, **k))
    index, low = suffix_dedup.repeated_strings(data, ends, ends, ends + 1, 50)
    assert sorted(index.tolist()) == list(range(len(ends))) and np.array_equal(low, ends[index])
    assert sum(n > 0 for n in sizes) < 10
