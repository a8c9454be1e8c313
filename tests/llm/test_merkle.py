import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import with_clashes

from gopmill.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def lower(text):
    return None if text is None else text.encode().lower().decode()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """Every row's result, in a plain loop over whole trees."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    grown = {lang: levels([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in order}
    crown = levels([grown[lang][-1][0] for lang in order])
    out = []
    for head, lang in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(by_lang[lang], key=lambda x: x[:3])):
            tampered = zlib.crc32(str("" if row.doc_id is None else row.doc_id).encode()) % 3 == 0
            node, proof = leaf(row, lower(row.text)) if tampered else own, []
            for tree, place in ((grown[lang], at), (crown, head)):
                for level in tree[:-1]:
                    low = place // 8 * 8
                    left, right = level[low:place], level[place + 1 : low + 8]
                    node = h(*left, node, *right)
                    proof += left + right
                    place //= 8
            out.append((row.doc_id, own, grown[lang][-1][0], crown[-1][0], h(*proof), node, node == crown[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("wide", [False, True])
def test_against_brute_force(docs, wide):
    got = merkle.op11(with_clashes(docs) if wide else docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.collect())


def test_many_languages_and_a_tree_of_several_layers(spark):
    """More leaves than two blocks hold in one language, more languages than one block holds."""
    from fixtures import frame

    langs = [f"l{n}" for n in range(600)] + ["en"] * 1100 + [None] * 3
    data = [(i, f"Text {i % 7}", lang, "s", 6) for i, lang in enumerate(langs)]
    docs = frame(spark, data).repartition(5)
    assert sorted(map(tuple, merkle.op11(docs).collect()), key=str) == brute(docs.collect())


@pytest.mark.parametrize("levels_", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout(levels_):
    """Every node has its own slot, and any subtree of a split at half height is one stretch of slots."""
    seen = np.concatenate([merkle.address(levels_, d, np.arange(8**d)) for d in range(levels_)])
    assert sorted(seen.tolist()) == list(range(merkle.slots(levels_)))
    upper = levels_ // 2
    if upper:
        for root in range(8**upper):
            below = np.concatenate([merkle.address(levels_, upper + d, root * 8**d + np.arange(8**d)) for d in range(levels_ - upper)])
            assert below.max() - below.min() + 1 == len(below)


def test_a_change_anywhere_changes_the_root(spark):
    from fixtures import frame, rows

    texts = [f"text {i}" for i in range(30)]
    root = merkle.op11(frame(spark, rows(*texts))).first().root
    texts[17] += "!"
    assert merkle.op11(frame(spark, rows(*texts))).first().root != root
