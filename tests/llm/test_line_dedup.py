from conftest import with_clashes
from fixtures import frame, prose, rows

from gopmill.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(data):
    """data: (doc_id, text). Equal rows are one document."""
    docs = sorted({(d is None, d or 0, t) for d, t in data if t is not None}, key=lambda x: x[:2])
    seen, status, out = [], {}, {}
    for none, doc, text in docs:
        kept, equal, near = [], 0, 0
        for line in text.split("\n"):
            words = line.encode().split()
            if not words:
                kept.append(line)
                continue
            if tuple(words) in status:
                near, equal = near + status[tuple(words)], equal + (not status[tuple(words)])
                continue
            close = [len(words) >= 5 and len(o) >= 5 and o != words and abs(len(o) - len(words)) < 2 and distance(words, o) == 1 for o in seen]
            near += any(close)
            status[tuple(words)] = any(close)
            if not any(close):
                kept.append(line)
            seen.append(words)
        out[(none, doc, text)] = (equal, near, "\n".join(kept))
    result = []
    for d, t in data:
        equal, near, text = out[(d is None, d or 0, t)] if t is not None else (0, 0, None)
        result.append((str(d), equal, near, len(text.split("\n")) if text is not None else 0, text))
    return sorted(result, key=str)


def got(docs):
    return sorted(((str(r.doc_id), *r[1:]) for r in line_dedup.op4(docs).collect()), key=str)


def test_against_brute_force_on_edges(spark, edge, empty):
    data = edge.collect()
    # a tie: different texts with one id are told apart by their hash, which the brute force does not know
    unique = [r for r in data if not (r.doc_id == 14 and r.lang == "fr") and not (r.doc_id is None and r.lang is not None)]
    df = frame(spark, [tuple(r) for r in unique])
    assert got(with_clashes(df)) == brute([(r.doc_id, r.text) for r in unique])
    assert got(empty) == []


def test_edits_of_every_kind_and_place(spark):
    base = prose(24, 1).split()
    texts = [" ".join(base), "other line here with words enough\n" + " ".join(base)]
    for i in range(0, 25, 3):
        texts.append(" ".join(base[:i] + ["new"] + base[i:]))
        texts.append(" ".join(base[:i] + ["put"] + base[i + 1 :]) + "\n" + prose(12, i))
        texts.append(" ".join(base[: max(i - 1, 0)] + base[i:]))
        texts.append("two " + " ".join(base[:i] + ["x"] + base[i + 1 :]) + " edits")
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11):
        texts += [" ".join(base[:n]), " ".join(base[: n - 1] + ["last"]), "\n\n".join([" ".join(base[1:n])] * 2)]
    data = rows(*texts)
    assert got(frame(spark, data)) == brute([(r[0], r[1]) for r in data])


def test_against_brute_force_on_documents(small):
    some = small.limit(60)
    assert got(some) == brute([(r.doc_id, r.text) for r in some.collect()])


def test_template_lines_meet_only_their_earliest(spark):
    texts = [f"{prose(8, 2)} item{i} {prose(8, 3)}" for i in range(300)]
    result = {r.doc_id: r.n_near_removed for r in line_dedup.op4(frame(spark, rows(*texts))).collect()}
    assert result[1] == 0 and all(result[i] == 1 for i in range(2, 301))


def test_short_lines_and_one_word_in_six(spark):
    texts = ["All rights reserved\nthe quick brown fox jumps over", "All rights reserved\nthe quick brown cat jumps over\n\n", "red fox\nred cat", "ok", " ok\t"]
    result = [(r.doc_id, r.n_equal_removed, r.n_near_removed, r.text) for r in line_dedup.op4(frame(spark, rows(*texts))).orderBy("doc_id").collect()]
    assert result == [(1, 0, 0, texts[0]), (2, 1, 1, "\n"), (3, 0, 0, texts[2]), (4, 0, 0, "ok"), (5, 1, 0, "")]


def test_no_repeated_line_is_left(spark, small):
    left = [tuple(line.encode().split()) for r in line_dedup.op4(small).collect() if r.text is not None for line in r.text.split("\n")]
    left = [line for line in left if line]
    assert len(left) == len(set(left))


def test_filter_keeps_columns_and_drops_emptied_documents(spark, docs):
    wide = with_clashes(docs)
    kept = line_dedup.drop_repeated_lines(wide)
    assert kept.columns == wide.columns
    for r in kept.select("n_chars", "text").collect():
        assert r.text is None or r.n_chars is None or r.n_chars == len(r.text)
    copies = frame(spark, rows(prose(30, 1), prose(30, 1), "short", None))
    assert sorted(r.doc_id for r in line_dedup.drop_repeated_lines(copies).collect()) == [1, 3, 4]
