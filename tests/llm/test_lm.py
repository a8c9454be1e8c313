import math
import zlib
from collections import Counter

import numpy as np

from gopmill.llm import lm
from gopmill.llm.textarrays import Bloom, mixed


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_scores_against_brute_force(docs):
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    count = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        words = tokens(r.text)
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in words)
        want.append((str(r.doc_id), held(r.doc_id), len(words), sum(1 for t in words if count[t]), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.op10(docs).collect()]
    assert sorted(got) == sorted(want)


def test_the_model_beats_single_words_on_held_out_texts(small):
    rows = [r for r in lm.op10(small).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_filter_gives_back_levels():
    rng = np.random.default_rng(0)
    h = mixed(rng.integers(0, 2**63, 20000).astype(np.uint64))
    count = rng.integers(1, 1000, len(h))
    held = lm.entries(h, count)
    parts = [held[(held >> np.uint64(32)) * np.uint64(4) >> np.uint64(32) == b] for b in range(4)]
    bloom = Bloom([Bloom.segment(p, 12 * len(p)) for p in parts])
    level = lm.probe(bloom, h)
    true = lm.level_of(count)
    assert (level >= true).all() and (level == true).mean() > 0.97
    assert (lm.probe(bloom, mixed(h + np.uint64(1))) > 0).mean() < 0.03


def brute_scores(rows, least):
    """The model with exact counts in place of the filter: (doc_id, score)."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    value = lambda c: 0 if not c else 1 if c == 1 else 0.75 * 2 ** (1 + int(math.log2(c)))
    one, two = Counter(), Counter()
    for r in rows:
        if not held(r.doc_id):
            words = tokens(r.text)
            one.update(words)
            two.update(zip([None, *words[:-1]], words, strict=True))
    n, v, out = sum(one.values()), len(one), []
    for r in rows:
        words, score = tokens(r.text), 0
        for a, b in zip([None, *words[:-1]], words, strict=True):
            past, pair = value(one[a]), value(two[a, b] if two[a, b] >= least else 0)
            weight = 0.4 * past / (past + 10)
            score += math.log10(weight * min(pair / max(past, 1), 1) + (1 - weight) * (value(one[b]) + 0.1) / (n + 0.1 * (v + 1)))
        out.append((str(r.doc_id), score))
    return sorted(out)


def close(df, want):
    got = sorted((str(r.doc_id), r.score) for r in lm.op10(df).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    # a wrong hit of the filter makes a score too high, about one in 200
    assert sum(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 0.01 * sum(abs(b[1]) for b in want)


def test_scores_do_not_depend_on_a_bound_of_the_filter(small, monkeypatch):
    monkeypatch.setattr(lm, "MAX_FILTER_BITS", 1 << 12, raising=False)
    close(small, brute_scores(small.collect(), getattr(lm, "MIN_PAIR_COUNT", 1)))


def test_pairs_seen_once_count(small):
    close(small, brute_scores(small.collect(), 1))


def test_groups_of_the_same_rows_are_scored_once_each(spark, small, tmp_path):
    small.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.union(one).rdd.getNumPartitions() == 2
    twice = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.op10(one.union(one)).collect())
    rows = small.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text) * 2)
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
    each = [(str(r.doc_id), len(t), sum(1 for x in t if count[x]), round(base(t), 6)) for r in rows for t in [tokens(r.text)]]
    assert twice == sorted(each * 2)
