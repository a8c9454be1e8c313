import numpy as np
import pyarrow as pa
import xxhash
from conftest import with_clashes
from fixtures import frame, prose, rows

from gopmill.llm import simhash
from gopmill.llm.textarrays import column_texts


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, bits):
    top = list(range(len(prints)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_classes_against_brute_force(docs):
    data = docs.collect()
    prints = [brute_print(r.text) for r in data]
    label = brute_classes(prints, 4)
    ids = {}
    for r, c in zip(data, label, strict=True):
        if r.doc_id is not None:
            ids[c] = min(ids.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{p:016x}", str(ids.get(c))) for r, p, c in zip(data, prints, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op5(docs).collect()) == want


def planted(n=600, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    out = list(base)
    for p in base[: n // 2]:
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            p = p ^ np.uint64(sum(1 << int(b) for b in flips))
            out.append(p)
    return np.unique(np.array(out, np.uint64))


def test_links_join_the_same_classes_with_any_shard_size(spark):
    points = planted()
    want = brute_classes([int(p) for p in points], 4)
    for segments, rows_each in ((5, 1 << 14), (6, 1 << 14), (5, 8)):
        df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
        found = simhash.links(df, 4, segments, rows_each)
        at = {int(p): i for i, p in enumerate(points.view(np.int64))}
        top = list(range(len(points)))

        def find(a, top=top):
            while top[a] != a:
                a = top[a]
            return a

        for r in found.collect():
            assert (int(points[at[r.a]]) ^ int(points[at[r.b]])).bit_count() <= 4
            top[find(at[r.a])] = find(at[r.b])
        groups = {}
        for i, c in enumerate(want):
            groups.setdefault(c, set()).add(find(i))
        assert all(len(g) == 1 for g in groups.values())
        assert len({find(i) for i in range(len(points))}) == len(groups)


def test_tree_search_on_one_dense_group():
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    points = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(2000)], np.uint64))
    forest = simhash.Forest()
    simhash.tree_links(points, 4, forest)
    label = brute_classes([int(p) for p in points], 4)
    assert len(forest.links) == len(points) - len(set(label))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 260))


def test_one_row_of_each_class_stays(docs):
    wide = with_clashes(docs)
    kept = simhash.keep_first(wide)
    assert kept.columns == wide.columns
    labels = simhash.classes(docs).select("label").distinct().count()
    assert kept.count() == labels
    named = {r.component_id for r in simhash.op5(docs).collect()} - {None}
    assert named <= {r.doc_id for r in kept.collect()}


def test_near_copies_meet(spark):
    words = prose(400, 7).split()
    words[200] = "changed"
    got = {r.doc_id: r.component_id for r in simhash.op5(frame(spark, rows(prose(400, 7), " ".join(words), prose(400, 8)))).collect()}
    assert got[2] in (1, 2) and got[3] == 3


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_similar(texts):
    """Classes of texts of which every two are compared, by fingerprints and by shingles, without bands."""
    prints = [simhash.wide_print(h)[0] for h in simhash.shingle_sets(column_texts(pa.array(texts, pa.string())))]
    prints, sets = [int.from_bytes(p.tobytes(), "little") for p in prints], [shingle_set(t) for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= simhash.WIDE_BITS
            if top[i] != top[j] and near and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                top = [top[j] if t == top[i] else t for t in top]
    return top


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def edited(words, changes, rng):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def test_similar_classes_against_brute_force(docs):
    at = {(str(r.doc_id), r._key): bytes(r.label) for r in simhash.similar_classes(docs).collect()}
    data = docs.select("doc_id", "text", simhash.key()).collect()
    got, sets = [at[str(r.doc_id), r._key] for r in data], [shingle_set(r.text) for r in data]
    assert same_partition(got, brute_similar([r.text for r in data]))
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            assert s < 0.8 or got[i] == got[j]


def test_similar_texts_are_found_and_others_are_not(spark):
    """Of pairs of similarity 0.8 or more at least 0.9 are found, of pairs under 0.65 none."""
    rng = np.random.default_rng(5)
    texts = []
    for words, changes, pairs in ((60, 1, 60), (120, 2, 60), (400, 6, 40), (1000, 20, 20), (200, 12, 60)):
        for _ in range(pairs):
            base = prose(words, int(rng.integers(1 << 20))).split()
            texts += [" ".join(base), edited(base, changes, rng)]
    label = {r.doc_id: bytes(r.label) for r in simhash.similar_classes(frame(spark, rows(*texts))).collect()}
    close, found = 0, 0
    for i in range(0, len(texts), 2):
        a, b = shingle_set(texts[i]), shingle_set(texts[i + 1])
        s = len(a & b) / len(a | b)
        met = label[i + 1] == label[i + 2]
        close, found = close + (s >= 0.8), found + (s >= 0.8 and met)
        assert s >= 0.65 or not met
    assert close > 120 and found >= 0.9 * close
    assert len(set(label.values())) >= len(texts) // 2


def test_blocks_of_a_large_shard_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = prose(150, 11).split()
    texts = [edited(base, 2, rng) for _ in range(120)] + [prose(150, 200 + i) for i in range(20)]
    docs = frame(spark, rows(*texts))
    whole, cut = ({r.doc_id: bytes(r.label) for r in simhash.similar_classes(docs, simhash.WIDE_BITS, n).collect()} for n in (1 << 15, 8))
    assert whole == cut and len(set(whole.values())) == 21


def test_grown_links_join_all_that_is_close():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (6, simhash.WIDE_WORDS)).astype(np.uint64)
    points = []
    for center in base:
        for _ in range(60):
            flips = np.zeros(64 * simhash.WIDE_WORDS, np.uint8)
            flips[rng.choice(len(flips), rng.integers(20, 130), replace=False)] = 1
            points.append(center ^ np.packbits(flips, bitorder="little").view(np.uint64))
    points = np.array(points)
    want = brute_classes([int.from_bytes(p.tobytes(), "little") for p in points], simhash.WIDE_BITS)
    found = simhash.grown_links(points, simhash.WIDE_BITS)
    forest = simhash.Forest()
    forest.link(*(np.array(x) for x in zip(*found, strict=True)))
    assert same_partition([forest.top(i) for i in range(len(points))], want) and len(found) == len(points) - len(set(want))


def test_one_similar_row_stays(docs):
    wide = with_clashes(docs)
    kept = simhash.keep_one_similar(wide)
    assert kept.columns == wide.columns and kept.count() == simhash.similar_classes(docs).select("label").distinct().count()


def test_texts_a_little_under_the_similarity_stay_apart(spark):
    """Pairs of 0.72 to 0.79, which the bits alone would mostly link, and chains in which only some steps are near enough."""
    rng = np.random.default_rng(8)
    texts = []
    for changes in (5, 6):
        for _ in range(30):
            base = prose(200, int(rng.integers(1 << 20))).split()
            texts += [" ".join(base), edited(base, changes, rng)]
    base = prose(200, 99).split()
    texts.append(" ".join(base))
    for at in range(12):
        base = edited(base, 1 + 5 * (at % 3 == 2), rng).split()
        texts.append(" ".join(base))
    got = {r.doc_id: bytes(r.label) for r in simhash.similar_classes(frame(spark, rows(*texts))).collect()}
    pairs, sets = [(i, i + 1) for i in range(0, 120, 2)], [shingle_set(t) for t in texts]
    under = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])]
    assert len(under) > 40 and all(got[i + 1] != got[j + 1] for i, j in under)
    assert same_partition([got[i + 1] for i in range(len(texts))], brute_similar(texts))


def test_classes_of_many_shingles_are_cut_without_losing_a_link(spark):
    rng = np.random.default_rng(9)
    base = prose(150, 12).split()
    texts = [edited(base, 2, rng) for _ in range(60)] + [edited(base, 5, rng) for _ in range(30)]
    docs = frame(spark, rows(*texts)).select(simhash.key(), "text")
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    h = [(simhash._node(x), x) for x in simhash.shingle_sets(column_texts(pa.array(texts, pa.string())))]
    keys = {r.text: r._key for r in docs.collect()}
    members = spark.createDataFrame(
        [(n, b"all", len(x), simhash.wide_print(x)[0].tobytes(), keys[t]) for (n, x), t in zip(h, texts, strict=True)],
        "node binary, label binary, size bigint, print binary, _key bigint",
    )
    place, forests = {n: i for i, (n, _) in enumerate(h)}, []
    for shingles in (1 << 22, 1000):
        found = simhash.checked_links(docs, members, shard_shingles=shingles).collect()
        pairs = [(place[bytes(r.a)], place[bytes(r.b)]) for r in found]
        assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in pairs)
        forest = simhash.Forest()
        forest.link(*(np.array(x) for x in zip(*pairs, strict=True)))
        forests.append([forest.top(i) for i in range(len(texts))])
    assert same_partition(*forests) and same_partition(forests[0], brute_similar(texts))


def test_no_pair_of_the_similarity_is_lost(spark, monkeypatch):
    """All pairs of 0.8 or more are joined, whatever their bits and bands: the shortest ones, and long ones at the very edge."""
    rng = np.random.default_rng(10)
    texts = []
    for i in range(60):
        base = prose(9, 5000 + i).split()
        texts += [" ".join(base[:8]), " ".join(base)]
    for i in range(200):
        base = prose(int(rng.integers(45, 54)), 6000 + i).split()
        texts += [" ".join(base), " ".join([*base[:-1], *(f"more{k}" for k in range(10))])]
    sets = [shingle_set(t) for t in texts]
    close = [i for i in range(0, len(texts), 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    assert len(close) > 150
    docs = frame(spark, rows(*texts))
    for sampled, frequent in ((16, 16), (1, 2)):
        monkeypatch.setattr(simhash, "SAMPLED", sampled)
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
        label = {r.doc_id - 1: bytes(r.label) for r in simhash.similar_classes(docs).collect()}
        assert [i for i in range(0, len(texts), 2) if label[i] == label[i + 1]] == close


def test_prefixes_propose_every_similar_pair_of_two_classes(spark):
    rng = np.random.default_rng(11)
    base = prose(60, 13).split()
    texts = list(dict.fromkeys(edited(base, int(rng.integers(1, 4)), rng) for _ in range(80)))
    texts += [" ".join(texts[i].split()[: int(rng.integers(8, 60))]) for i in range(40)]
    sets = [np.array(h) for h in simhash.shingle_sets(column_texts(pa.array(texts, pa.string())))]
    found, counts = np.unique(np.concatenate(sets), return_counts=True)
    for least in (1000, 10):
        often = counts >= least
        firsts = [simhash.prefix(h, found[often], counts[often]).view(np.int64).tolist() for h in sets]
        prints = spark.createDataFrame([*enumerate(firsts), *enumerate(firsts[:9])], "id bigint, prefix array<bigint>")
        named = spark.createDataFrame([(i, i // 2, len(h)) for i, h in enumerate(sets)], "id bigint, tag bigint, size bigint")
        want = set()
        for i, a in enumerate(sets):
            for j in range(i):
                shared = len(np.intersect1d(a, sets[j]))
                if i // 2 != j // 2 and 5 * shared >= 4 * (len(a) + len(sets[j]) - shared):
                    want.add((j // 2, i // 2))
        assert len(want) > 50
        for block in (1 << 10, 7):
            got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.shared_prefixes(prints, named, block).collect()}
            assert want <= got
