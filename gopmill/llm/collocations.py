"""Phrases of two to four words that occur together far more often than their parts, per language.

A phrase counts as frequent from ``least`` occurrences on. First pass: each group of some megabytes of text counts its
n-grams of one to four words by hash, and the counts are dealt out by hash to partitions. A partition folds them into a
Misra-Gries summary: counters by n-gram, of which, whenever there are more than the capacity, all are lowered by the
largest that does not fit, and those at zero go. What a counter has lost is at most mass / (capacity + 1) in all, however
the summaries are merged; with a capacity above mass / least that is below ``least``, so every frequent n-gram survives. The
partition answers each group with a bit for each n-gram that the group sent. Second pass: each group counts the surviving
n-grams as texts, and their exact totals are an ordinary aggregate; what only shared a hash or was near the bound goes then.

What is bounded: a group holds GROUP_BYTES of text (one longer text is a group alone), a partition BUCKET_BYTES of text's
n-grams in compressed form and a summary of mass / least counters; what is frequent is at most the mass divided by
``least``. Groups are written first, so both passes see the same groups whatever is computed again. A group sends at most
one blob to a partition, and never more of them than it has n-grams; for hundreds of terabytes raise both sizes with the
executors' memory. In a group n-grams are told apart by 64-bit hashes.

Null texts are empty, null languages 'und'; empty texts have no words. Repeated rows count as often as they occur. Ties in
score and count are ordered by the phrase's bytes. Other columns than lang and text are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import bucket_count
from gopmill.llm.textarrays import U64, Texts, bucket_edges, mixed, packed, slices, unpacked
from gopmill.session import written

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
CONTAINED_PERCENT = 80
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
SHARDS = 64
CUTS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
BLANKS = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
GROUP = "group bigint, langs array<string>, blob binary"
SENT = "bucket int, group bigint, mass bigint, blob binary"


# -- n-grams of a group of texts --------------------------------------------------------------------------------------


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of every word, and whether it follows the word before it in one piece."""
    cut = CUTS[texts.data]
    text, start, end = texts._spans(~(cut | BLANKS[texts.data]))
    cuts_before = np.cumsum(cut)[start] if len(start) else start
    follows = np.zeros(len(text), bool)
    follows[1:] = (text[1:] == text[:-1]) & (cuts_before[1:] == cuts_before[:-1])
    return text, start, end, follows


def n_grams(hashes: np.ndarray, follows: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the first word and the hash of each n-gram, given the words' hashes."""
    first, h = np.arange(len(hashes)), hashes
    for size in range(1, longest + 1):
        if size > 1:
            inside = first + (size - 1) < len(hashes)
            first, h = first[inside], h[inside]
            joined = follows[first + (size - 1)]
            first, h = first[joined], h[joined]
            h = mixed(h * U64(0xC2B2AE3D27D4EB4F) + hashes[first + (size - 1)])
        yield first, h


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _parts(row: dict) -> Iterator[tuple[np.ndarray, Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a group in slices: languages, texts in lower case, words, and each word's hash with its language's."""
    codes, lengths, data = unpacked(row["blob"])
    seeds = np.array([_seed(x) for x in row["langs"]], U64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
    batch = pa.RecordBatch.from_arrays([column, pa.array(codes)], names=["text", "code"])
    for part, texts in slices([batch]):
        own, low = part.column("code").to_numpy(), texts.lower()
        text, start, end, follows = words(low)
        yield own, low, text, start, end, follows, mixed(low.hashes(start, end) ^ seeds[own[text]])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in groups of about GROUP_BYTES: the languages, and a blob of each text's language, length and bytes."""
    held, size = [], 0

    def flush():
        named = pa.chunked_array([b.column("lang") for b, _ in held]).combine_chunks().dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        blob = packed(codes, np.concatenate([t.lengths for _, t in held]), np.concatenate([t.data for _, t in held]))
        return pa.RecordBatch.from_pydict({"langs": [named.dictionary.to_pylist()], "blob": pa.array([blob], pa.binary())})

    for part in slices(batches):
        held.append(part)
        size += len(part[1].data) + 1
        if size >= GROUP_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _hashed(row: dict, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a group's n-grams, sorted, and how often each occurs."""
    found = [h for *_, follows, h0 in _parts(row) for _, h in n_grams(h0, follows, longest)]
    every = np.concatenate(found) if found else np.zeros(0, U64)
    del found
    every.sort()  # in place: a copy of a group's hashes is the most that a task holds
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    first = np.flatnonzero(new)
    return every[first], np.diff(first, append=len(every))


def _send(buckets: int, longest: int):
    """First pass: the upper 48 bits of each distinct n-gram of a group and its count, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, count = _hashed(row, longest)
                edges = bucket_edges(h, buckets)
                for b in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[b], edges[b + 1])
                    blob = packed(np.diff(h[part] >> U64(16), prepend=U64(0)), count[part].astype(np.int32))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b], pa.int32()), "group": pa.array([row["group"]], pa.int64()),
                        "mass": pa.array([int(count[part].sum())], pa.int64()), "blob": pa.array([blob], pa.binary()),
                    })

    return run


class MisraGries:
    """Counters of the most frequent of a stream of counted keys, at most ``capacity`` of them between merges.

    A key's true count is at most its counter plus ``lost``, and ``lost`` is at most the mass divided by capacity + 1.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Takes in counted keys, repeats allowed, or the counters of another summary and what it has lost."""
        merged, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(merged) > self.capacity:
            spare = len(merged) - self.capacity - 1
            cut = int(np.partition(total, spare)[spare])
            total -= cut
            merged, total = merged[total > 0], total[total > 0]
            self.lost += cut
        self.keys, self.counts = merged, total

    def reaching(self, least: int) -> np.ndarray:
        """Every key that may have been seen ``least`` times, sorted."""
        return self.keys[self.counts + self.lost >= least]


def _survive(least: int):
    """One bucket: a summary of all its counts, and for each group the bits of its surviving n-grams."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        blobs = table.column("blob")
        summary = MisraGries(sum(table.column("mass").to_pylist()) // least + 1)
        held, size = [], 0

        def merge():
            if held:
                summary.merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]).astype(np.int64))

        for blob in blobs:
            steps, counts = unpacked(blob.as_py())
            held.append((np.cumsum(steps, dtype=U64), counts))
            size += len(counts)
            if size > summary.capacity:  # so that merges cost no more than what they take in
                merge()
                held, size = [], 0
        merge()
        alive = summary.reaching(least)
        bits = []
        for blob in blobs:
            keys = np.cumsum(unpacked(blob.as_py())[0], dtype=U64)
            at = np.minimum(np.searchsorted(alive, keys), max(len(alive) - 1, 0))
            bits.append(packed(alive[at] == keys) if len(alive) else packed(np.zeros(len(keys), bool)))
        return table.set_column(table.schema.get_field_index("blob"), "blob", pa.array(bits, pa.binary()))

    return run


def _count(longest: int):
    """Second pass, one group: how often each surviving n-gram occurs, as texts, and the words of each language."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["bucket"] < 0)
        h, _ = _hashed(own, longest)
        bits = [unpacked(r["blob"])[0] for r in sorted(rows, key=lambda r: r["bucket"]) if r["bucket"] >= 0]
        alive = h[np.concatenate(bits)] if bits else h[:0]
        total, phrase = np.zeros(len(alive), np.int64), [None] * len(alive)
        lang, length = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int32)
        spoken = np.zeros(len(own["langs"]), np.int64)
        for codes, texts, text, start, end, follows, word in _parts(own):
            spoken += np.bincount(codes[text], minlength=len(spoken))
            data = texts.data.tobytes()
            for size, (first, found) in enumerate(n_grams(word, follows, longest), 1):
                if not len(alive):
                    continue
                at = np.minimum(np.searchsorted(alive, found), len(alive) - 1)
                hit = alive[at] == found
                seen, where, count = np.unique(at[hit], return_index=True, return_counts=True)
                total[seen] += count
                where = first[hit][where]
                lang[seen], length[seen] = codes[text[where]], size
                for i, low, high in zip(seen.tolist(), start[where].tolist(), end[where + (size - 1)].tolist(), strict=True):
                    if phrase[i] is None:
                        phrase[i] = data[low:high] if size == 1 else b" ".join(data[low:high].split())
        names = pa.array(own["langs"], pa.string())
        return pa.table({
            "lang": pa.concat_arrays([names, names.take(pa.array(lang))]),
            "phrase": pa.concat_arrays([pa.nulls(len(names), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string())]),
            "size": pa.array(np.concatenate([np.zeros(len(names), np.int32), length])),
            "a": pa.array(np.concatenate([spoken, total])),
        })

    return run


# -- over all texts -----------------------------------------------------------------------------------------------------


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a): every n-gram with at least ``least`` occurrences, and per language its words as size 0."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = bucket_count(texts, BUCKET_BYTES)
    grouped = texts.mapInArrow(_grouped, "langs array<string>, blob binary")
    groups = written(grouped.withColumn("group", F.monotonically_increasing_id()))
    sent = groups.mapInArrow(_send(buckets, longest), SENT)
    answers = written(sent.groupBy("bucket").applyInArrow(_survive(least), SENT).select("bucket", "group", "blob"))
    own = groups.select(F.lit(-1).alias("bucket"), "group", "blob", "langs")
    both = own.unionByName(answers, allowMissingColumns=True)
    counted = both.groupBy("group").applyInArrow(_count(longest), "lang string, phrase string, size int, a bigint")
    total = counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))
    return written(total.where((F.col("a") >= least) | (F.col("size") == 0)))


def _big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def _slice(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, k, l, r): each phrase by its lowest-scoring cut, the first of equals."""
    phrases = counts.where(F.col("size") >= 2).withColumn("words", F.split("phrase", " "))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k", _slice(F.lit(1), F.col("k")).alias("_first"),
        _slice(F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"),
    )
    parts = counts.where(F.col("size") >= 1)
    firsts = parts.select("lang", F.col("phrase").alias("_first"), F.col("a").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("_rest"), F.col("a").alias("r"))
    both = cut.join(firsts, ["lang", "_first"]).join(rests, ["lang", "_rest"])
    # decimals: the product may not fit into 64 bits, the quotient does
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * _big("a"), _big("l") + _big("r"))
    best = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("_best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "_best.*")


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer frequent phrase that holds the phrase."""
    longer = counts.where(F.col("size") >= 3).withColumn("words", F.split("phrase", " "))
    spans = longer.withColumn("_length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    spans = spans.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_length") + 1)))
    inner = spans.select("lang", _slice(F.col("_at"), F.col("_length")).alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Each language's first ``top`` phrases that are not mostly part of a longer one: rank, phrase, counts and score."""
    counts = frequent(docs, least, longest)
    part = F.lit(100).cast("decimal(3,0)") * _big("longer") >= F.lit(CONTAINED_PERCENT).cast("decimal(3,0)") * _big("a")
    kept = scored(counts).join(contained(counts), ["lang", "phrase"], "left").where(~F.coalesce(part, F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each of SHARDS parts hold the first of all, so the last window sees a bounded number of rows
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    of_shard = F.row_number().over(Window.partitionBy("lang", "_shard").orderBy(*order))
    first = kept.withColumn("_shard", shard).withColumn("rank", of_shard).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    spoken = counts.where(F.col("size") == 0).select("lang", F.col("a").alias("n"))
    return ranked.where(F.col("rank") <= top).join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = f"""WITH pieces AS MATERIALIZED (
 SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
   SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
spoken AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
   SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) sizes(size) WHERE len(w) >= size)),
counts AS MATERIALIZED (SELECT lang, phrase, any_value(size) AS size, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM (
   SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size >= 2)),
best AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST((CAST({SCALE} AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) AS score
   FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
   QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
   SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM counts WHERE size >= 3)) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
   FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.phrase = b.phrase
   WHERE p.longer IS NULL OR CAST(100 AS HUGEINT) * p.longer < CAST({CONTAINED_PERCENT} AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN spoken USING (lang) WHERE rank <= {TOP}"""
