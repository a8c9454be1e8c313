import hashlib
import re

from conftest import with_clashes
from fixtures import FOLDER, frame, prose, rows
from pyspark.sql import functions as F

from gopmill.llm import decontamination


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(len(w) - 9, 1) if w else 0):
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i : i + size]))
                if ids:
                    hit |= set(range(i, i + size))
                    found |= ids
        listed = ",".join(sorted(found))
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def result(docs, items):
    return sorted((str(r.doc_id), *r[1:6]) for r in decontamination.op1(docs, items).collect())


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def test_against_brute_force(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(with_clashes(docs), items) == want


def test_short_repeated_and_overlapping_items(spark):
    long = prose(30, 1)
    items = spark.createDataFrame(
        [(1, long), (2, "the the"), (3, "É-Ü Été"), (4, None), (5, ""), (None, long), (6, long), (7, "the " * 14), (10, "ONE")], "item_id bigint, text string"
    )
    data = rows(long.upper(), prose(5, 2) + ". " + long[:90] + "! " + long, "the the the", "É Ü été É ü Été; É Ü Été", "one", None, "", "the " * 30, long.replace(" ", "--"))
    docs = frame(spark, data)
    assert result(docs, items) == brute([(r[0], r[1]) for r in data], [(r.item_id, r.text) for r in items.collect()])


def test_blocks_of_terms_give_the_same(spark, small, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = result(small, items)
    monkeypatch.setattr(decontamination, "MAX_TERMS", 100)
    assert result(small, items) == whole


def test_no_items(spark, small):
    assert all(not r.contaminated and r.n_words >= 0 for r in decontamination.op1(small, bench(spark)).collect())


def test_proximity_ignores_order(spark):
    item = prose(10, 3).split()
    docs = frame(spark, rows(" ".join(item), " ".join(reversed(item)), " ".join(item[:9]), prose(20, 4)))
    index = decontamination.Index(docs, bench(spark, " ".join(item)))
    near = {r[0] for r in index.proximity_matches().select("_key").collect()}
    exact = {r[0] for r in index.phrase_matches().select("_key").collect()}
    assert len(near) == 2 and len(exact) == 1 and exact <= near


def test_filter_keeps_columns(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    wide = with_clashes(docs)
    kept = decontamination.keep_clean(wide, items)
    assert kept.columns == wide.columns
    assert kept.count() == decontamination.op1(docs, items).filter("not contaminated").count()


def test_index_holds_lengths_and_joined_neighbours(spark):
    item = prose(12, 3)
    docs = frame(spark, rows(item, prose(7, 5), "", None, "--", prose(7, 5)))
    index = decontamination.Index(docs, bench(spark, item))
    held = sorted(r.n_words for r in index.lengths().collect())
    assert held == sorted([len(words(item)), len(words(prose(7, 5))), len(words(prose(7, 5))), 0, 0])
    assert dict(index.postings.dtypes)["near"] == "string"
    counts = {r.doc_id: r.n_words for r in decontamination.op1(docs, bench(spark, item)).collect()}
    assert sorted(counts.values()) == sorted([*held, 0])


def test_words_are_those_of_the_contract(spark):
    every = " ".join(f"a{chr(c)}B" for c in [*range(0x250), 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x10FFFF])
    for text in (every, "Plain ASCII: x_y z9-9 [A]@`b{c}"):
        got = spark.createDataFrame([(text,)], "text string").select(decontamination.words(F.col("text"))).first()[0]
        assert got == words(text)
