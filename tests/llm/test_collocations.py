import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import with_clashes

from gopmill.llm import collocations


def brute(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        text = (r.text or "").encode().lower().decode()
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        found = []
        for p, a in frequent.items():
            if p in covered and 100 * covered[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("top", "least"), [(2000, 30), (5, 3), (100000, 2)])
def test_against_brute_force(docs, top, least):
    got = sorted(map(tuple, collocations.collocations(docs, top, least).collect()))
    assert got == brute(docs.collect(), top, least)


def test_other_columns_do_not_matter(edge):
    assert sorted(map(tuple, collocations.collocations(with_clashes(edge), 50, 3).collect())) == brute(edge.collect(), 50, 3)


def test_pieces_and_null_languages(spark):
    from fixtures import frame

    text = "New  York\tCity, new york; NEW YORK! New\x0bYork New: York new york É new york é " * 10
    data = [(i, text, lang, None, None) for i, lang in enumerate([None, "und", "en", None])] + [(9, None, None, None, None)]
    docs = frame(spark, data)
    got = sorted(map(tuple, collocations.collocations(docs, 2000, 4).collect()))
    assert got == brute(docs.collect(), 2000, 4)
    assert {r[0] for r in got} == {"und", "en"}


def test_many_partitions_and_groups(spark, small, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 20_000)
    got = sorted(map(tuple, collocations.collocations(small.repartition(9), 2000, 3).collect()))
    assert got == brute(small.collect(), 2000, 3)


@pytest.mark.parametrize("seed", range(20))
def test_summaries_keep_every_frequent_key(seed):
    """However counts are dealt to summaries and merged, no key of ``least`` occurrences is lost."""
    rng = np.random.default_rng(seed)
    keys = (rng.zipf(1.3, 5000) % 1500).astype(np.uint64)
    least = int(rng.integers(2, 40))
    capacity = len(keys) // least + 1
    whole = collocations.MisraGries(capacity)
    for part in np.array_split(keys, rng.integers(1, 9)):
        own = collocations.MisraGries(capacity)
        for chunk in np.array_split(part, rng.integers(1, 9)):
            own.merge(chunk, np.ones(len(chunk), np.int64))
            assert len(own.keys) <= capacity
        whole.merge(own.keys, own.counts, own.lost)
    true = Counter(keys.tolist())
    assert whole.lost < least
    assert {k for k, c in true.items() if c >= least} <= set(whole.reaching(least).tolist())
    for k, c in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True):
        assert c <= true[k] <= c + whole.lost


def test_products_beyond_64_bits(spark):
    big = 9 * 10**18
    counts = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big // 2), ("x", "a b", 2, big // 4), ("x", "a b c", 3, big // 5)], "lang string, phrase string, size int, a bigint")
    rows = counts.union(spark.createDataFrame([("x", "b c", 2, big // 3), ("x", "c", 1, big // 3)], counts.schema))
    got = {r.phrase: (r.score, r.k) for r in collocations.scored(rows).collect()}
    assert got["a b"] == (2000000 * (big // 4) // (big + big // 2), 1)
    assert {r.phrase: r.longer for r in collocations.contained(rows).collect()} == {"a b": big // 5, "b c": big // 5}
