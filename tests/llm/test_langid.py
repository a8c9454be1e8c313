import itertools
import zlib

import numpy as np
from conftest import with_clashes
from fixtures import frame, prose, rows

from gopmill.llm import langid


def test_forward_backward_against_all_sequences(monkeypatch):
    rng = np.random.default_rng(0)
    for pieces in (1, 3, 512):
        monkeypatch.setattr(langid, "PIECES", pieces)
        for n, k in ((1, 2), (5, 3), (9, 2), (17, 2)):
            scores, start, step = rng.normal(size=(n, k)), np.exp(rng.normal(size=k)), np.exp(rng.normal(size=(k, k)))
            first = rng.random(n) < 0.3
            first[0] = True
            label, steps, total = np.zeros((n, k)), np.zeros((k, k)), 0
            for y in itertools.product(range(k), repeat=n) if n < 12 else ():
                p = np.exp(sum(scores[t, y[t]] for t in range(n)))
                for t in range(n):
                    p *= start[y[t]] if first[t] else step[y[t - 1], y[t]]
                total += p
                for t in range(n):
                    label[t, y[t]] += p
                    if not first[t]:
                        steps[y[t - 1], y[t]] += p
            got, got_steps = langid.forward_backward(scores, first, start, step)
            assert np.allclose(got.sum(1), 1)
            if n < 12:
                assert np.allclose(got, label / total) and np.allclose(got_steps, steps / total)


def test_held_out_accuracy(small):
    truth = {r.doc_id: r.lang for r in small.collect()}
    got = langid.op6(small).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_switches_inside_a_text(small):
    model = langid.train(small)
    by = {r.lang: r.text for r in small.filter("n_chars > 600").collect()}
    a, b = " ".join(by["en"].split()[:60]), " ".join(by["de"].split()[:60])
    runs = langid.word_runs(frame(small.sparkSession, rows(a + " " + b)), model).collect()
    named = {}
    for r in runs:
        named[r.lang] = named.get(r.lang, 0) + r.n_words
    assert named.get("en", 0) > 45 and named.get("de", 0) > 45


def test_edges(docs):
    data = docs.collect()
    got = langid.op6(with_clashes(docs)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in data)
    ids = {}
    for r in data:
        ids.setdefault(r.doc_id, []).append(any(c.isalpha() for c in r.text or ""))
    langs = {r.lang for r in data}
    for r in got:
        assert r.lang_pred == "und" or r.lang_pred in langs
        if len(ids[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not ids[r.doc_id][0])


def test_nothing_to_learn_from(spark):
    df = frame(spark, [(1, prose(20), None, None, None), (2, "123 456", "en", None, None)])
    assert {(r.lang_pred, r.score) for r in langid.op6(df).collect()} <= {("und", 0.0), ("en", 1.0)}
    assert [r.lang_pred for r in langid.op6(frame(spark, [(1, prose(20), None, None, None)])).collect()] == ["und"]
