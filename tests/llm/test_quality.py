from collections import Counter

import pytest
from conftest import with_clashes

from gopmill.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(docs):
    got = sorted((str(r.doc_id), *r[1:6], r.base_failed) for r in quality.op9(docs).collect())
    want = []
    for r in docs.collect():
        m = brute(r.text)
        want.append((str(r.doc_id), *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want)


def test_base_failures_are_never_kept_and_clean_texts_are(docs):
    for r in quality.op9(docs).collect():
        assert not (r.base_failed and r.kept)
        assert r.kept == (r.failed_bits == 0)


def test_filter_keeps_columns_and_agrees_with_the_ledger(docs):
    wide = with_clashes(docs)
    kept = quality.keep_good(wide)
    assert kept.columns == wide.columns
    assert kept.count() == quality.op9(docs).filter("kept").count()


def test_ablation_counts_bits(docs):
    entries = quality.ledger(docs)
    bits = [r.failed for r in entries.select("failed").collect()]
    for r in quality.ablation(entries).collect():
        b, m = quality.BIT[r.rule], quality.mask(r.policy)
        beside = 0
        for x in bits:
            beside |= x & m & ~b if x & b else 0
        assert (r.failing, r.alone, r.beside) == (sum(1 for x in bits if x & b), sum(1 for x in bits if x & m == b), beside)


@pytest.mark.parametrize("policy", list(quality.POLICIES))
def test_policies_are_masks(small, policy):
    judged = quality.apply_policy(quality.ledger(small), policy)
    assert judged.filter(f"kept != ((failed & {quality.mask(policy)}) = 0)").count() == 0


def test_insults_reject_only_texts_full_of_them(spark):
    from fixtures import frame, prose, rows

    clean, rude = prose(100, 1), prose(40, 2) + " You idiot, you MORON; stupid! " + prose(40, 3)
    got = {r.doc_id: r.kept for r in quality.op9(frame(spark, rows(clean, rude))).collect()}
    assert got == {1: True, 2: False}
