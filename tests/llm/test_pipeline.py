import corpus_pipeline
import fixtures
import test_decontamination
import test_line_dedup
import test_packing
import test_simhash

from gopmill.llm import quality


def brute(spark, docs, items):
    """(doc_id, text) that come out of the first four stages; the quality verdict itself is compared in test_quality."""
    good = {r.doc_id for r in quality.op9(docs).collect() if r.kept}
    data = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    lines = test_line_dedup.brute(data)
    data = [(int(d), t) for d, equal, near, _, t in lines if not (equal or near) or t.split()]
    first = {}
    for (doc, text), c in zip(data, test_simhash.brute_similar([t for _, t in data]), strict=True):
        first[c] = min(first.get(c, (doc, text)), (doc, text))
    dirty = {r[0] for r in test_decontamination.brute(list(first.values()), items) if r[5]}
    return sorted((d, t) for d, t in first.values() if str(d) not in dirty)


def write(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_against_brute_force(spark, small, tmp_path):
    items = spark.read.parquet(f"{fixtures.FOLDER}/benchmark.parquet")
    folder = write(spark, tmp_path / "in", small.limit(90), items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute(spark, docs, [(r.item_id, r.text) for r in items.collect()])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert 0 < len(rows) < docs.count()
    test_packing.check(rows, [type("Doc", (), {"doc_id": d, "text": t}) for d, t in want], 16, 65536)


def test_edges(spark, tmp_path):
    data = fixtures.edges()
    data = [data[i] for i in range(len(data)) if not (data[i][0] == 14 and data[i][2] == "fr")]
    items = spark.createDataFrame([(1, fixtures.prose(12, 77)), (2, None)], "item_id bigint, text string")
    folder = write(spark, tmp_path / "in", fixtures.frame(spark, data), items)
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = [r.doc_id for r in rows]
    assert -5 in kept and 99 in kept and len(kept) == len(set(kept))


def test_empty_tables(spark, empty, tmp_path):
    folder = write(spark, tmp_path / "in", empty, spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_planted_copies_go_and_clean_documents_stay(spark, tmp_path):
    clean = [fixtures.prose(120, 100 + i) for i in range(20)]
    near = clean[0].split()
    near[60], near[90] = "changed", "too"  # on lines of their own, which two edits keep in the line stage
    item = fixtures.prose(15, 50)
    texts = [*clean, clean[1], " ".join(near), fixtures.prose(60, 51) + " " + item + " " + fixtures.prose(60, 52), "junk " * 200]
    folder = write(spark, tmp_path / "in", fixtures.frame(spark, fixtures.rows(*texts)), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == list(range(1, 21))


def test_few_insults_do_not_vanish_in_a_text(spark):
    texts = [fixtures.prose(100, 1), fixtures.prose(30, 2) + " MORON!", fixtures.prose(600, 3) + " idiot, scum, idiot", fixtures.prose(2000, 4) + " trash " * 3]
    docs = fixtures.frame(spark, fixtures.rows(*texts))
    assert [r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()] == [1]
