import hashlib
import re

from conftest import with_clashes
from fixtures import frame, prose, rows

from gopmill.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


HARD = [
    "a@b.c+d@e.f, x@y and.a@b-c.d.e@f.g @h.i j@k..l", "1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255 1.2.3 9.9.9.9.", "é 4111 1111 1111 1111 — 4111-1111-1111-1111x 4111  1111",
    "+1 (234) 555-7890) +12 +1+2345678901 +1.2.3.4.5.6.7.8.9.0 (+33)", "1" * 4000 + "@" + "b" * 3000, "a" * 20000, "😀 mail me😀 me@x.org 😀10.0.0.1\n\t+44 20 7946 0958",
    "1-2-3 4 " * 2000, "a.b" * 3000 + "@", "((((" * 2000 + "+1" + "(" * 5000,
]


def test_base_spans_against_brute_force(docs):
    want = sorted((str(r.doc_id), *[sum(s[3] == k for s in brute(r.text)) for k in pii.KINDS], hashlib.sha256(joined(brute(r.text)).encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), *r[1:6]) for r in pii.op7(with_clashes(docs)).collect()) == want


def test_hard_texts(spark):
    data = rows(*HARD)
    got = {r.doc_id: r for r in pii.op7(frame(spark, data)).collect()}
    for doc, text, *_ in data:
        assert got[doc].base_sha256 == hashlib.sha256(joined(brute(text)).encode()).hexdigest()
        assert set(joined(brute(text)).split(",")) <= set(got[doc].spans.split(","))


def test_contexts_find_identifiers_no_base_pattern_matches(spark):
    texts = [f"{prose(12, i)} contact mailbox user{i}@host{i}.example.org today {prose(9, 50 + i)}" for i in range(12)]
    texts += ["before contact mailbox (someone@intranet) today after", "an odd someone@intranet elsewhere", "contact mailbox 17 today"]
    got = {r.doc_id: r for r in pii.op7(frame(spark, rows(*texts))).collect()}
    assert got[13].spans == "email:24:40" and got[13].n_email == 0
    assert got[14].spans == "" and got[15].spans == ""
