"""Language-model scores from a log-frequency Bloom filter.

Counts of single words and of word pairs are gathered over all training texts, quantised to powers of two and stored
in a Bloom filter: an n-gram of level q is inserted q times, once per level, and its level is read back by probing
levels until one is missing. The filter has BITS_PER_ENTRY bits for every entry, whatever the corpus holds, so its error
rate is the same at every size; it is never in one place, but one segment per bucket of hashes. Every word and every pair
of the training texts goes in, those seen once too.

How it runs: texts are hashed word by word in Arrow batches, in groups of some megabytes. The distinct words and pairs
of a group (so a word in every text is one entry per group) and their training counts are cut by hash into buckets.
The task that owns a bucket adds up the counts, fills its segment of the filter, probes it, and sends the counts and
levels of each group's words and the levels of its pairs back to the group, where they meet the texts and make both
scores. Both passes over the texts must see the same rows in the same order, as scans do; else it is an error. Words are
told apart by 64-bit hashes.

Null and empty texts have one token, the end. Repeated rows are learned and scored as often as they occur; a null id
counts as ''. With no training text at all N is 0 and the base score is 0 a token, V being 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, bucket_count, key, remainder
from gopmill.llm.textarrays import U64, Bloom, Texts, bucket_edges, column_texts, mixed, packed, slices, unpacked
from gopmill.session import written

END = U64(0x51ED270B1F3A2C95)
BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 10 << 20
BITS_PER_ENTRY = 12
MAX_LEVEL = 48
PAIR_WEIGHT, FEW = 0.4, 10  # a pair's weight after a history seen n times: PAIR_WEIGHT * n / (n + FEW)
SMOOTH = 0.1


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every token: the words in lower case, then one end per text."""
    low = texts.lower()
    doc, start, end = low.words()
    n = len(texts.lengths)
    at = np.arange(len(doc)) + doc
    out, owner = np.full(len(doc) + n, END, U64), np.zeros(len(doc) + n, np.int64)
    out[at] = low.hashes(start, end)
    owner[at] = doc
    owner[np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)] = np.arange(n)
    return owner, out


def pairs(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and hash of each token's pair; before a text's first word stands an end."""
    before = np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes
    before[np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))] = END
    return before, mixed(before * U64(0xC2B2AE3D27D4EB4F) + hashes)


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: level q stands for about 2^(q - 1)."""
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def value_of(level: np.ndarray) -> np.ndarray:
    """Middle of a level's counts; 0 for level 0."""
    return np.where(level > 1, 0.75 * 2.0 ** level, np.where(level == 1, 1.0, 0.0))


def _at_level(h: np.ndarray, level: int) -> np.ndarray:
    return h ^ U64(level * 0x9FB21C651E98DF25 & 0xFFFFFFFF)  # the upper half names the bucket


def entries(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    level = np.minimum(level_of(count), MAX_LEVEL)
    return np.concatenate([_at_level(h[level >= q], q) for q in range(1, int(level.max(initial=0)) + 1)] or [h[:0]])


def probe(bloom: Bloom, h: np.ndarray) -> np.ndarray:
    """Levels read back from the filter."""
    level, at = np.zeros(len(h), np.int64), np.arange(len(h))
    for q in range(1, MAX_LEVEL + 1):
        at = at[bloom.holds(_at_level(h[at], q))]
        if not len(at):
            break
        level[at] = q
    return level


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Groups of texts of about FLUSH_BYTES: name, and a batch of row keys, held_out and text.

    The name is a hash of the group's rows: both passes over the texts give the same groups the same names.
    """
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = table.column(KEY).to_numpy()
        return int(mixed(np.cumsum(mixed(keys.view(U64)), dtype=U64)[-1:])[0].view(np.int64)), table

    for batch, texts in slices(batches):
        text = batch.schema.get_field_index("text")
        held.append(batch.set_column(text, pa.field("text", pa.large_string()), batch.column(text).cast(pa.large_string())))
        size += len(texts.data) + 1
        if size >= FLUSH_BYTES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of a group, slice by slice."""
    owner, h, base = [], [], 0
    for part, texts in slices([batch]):
        of, hashes = tokens(texts)
        owner.append(of + base)
        h.append(hashes)
        base += part.num_rows
    return np.concatenate(owner), np.concatenate(h)


def _pair_keys(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Upper 48 bits of each token's pair."""
    return pairs(owner, h)[1] >> U64(16)


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        columns = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _gather(buckets: int):
    """Of each group of texts by bucket: kind 1, its distinct words and their training counts; kind 2, the same of pairs."""

    def run(batches):
        for name, batch in _groups(batches):
            owner, h = _tokens(batch)
            taught = ~batch.column("held_out").to_numpy(zero_copy_only=False)[owner]
            out = []
            for kind, n_gram, shift in ((1, h, U64(0)), (2, _pair_keys(owner, h), U64(16))):
                u, at = np.unique(n_gram, return_inverse=True)
                trained = np.bincount(at[taught], minlength=len(u)).astype(np.int32)
                edges = bucket_edges(u << shift, buckets)
                for b in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[b], edges[b + 1])
                    out.append((b, name, kind, packed(np.diff(u[part], prepend=U64(0)), trained[part])))
            yield from _record(out, ["bucket", "group", "kind", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])

    return run


def _levels(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Level of each n-gram of a bucket, as its segment of the filter gives it back."""
    held = entries(h[count > 0], count[count > 0])
    return probe(Bloom([Bloom.segment(held, BITS_PER_ENTRY * len(held))]), h).astype(np.int8)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: a row with its sums, and for each group of texts the counts and levels of its words and pairs."""
    kinds, group, blob = (table.column(c).to_pylist() for c in ("kind", "group", "blob"))
    bucket = table.column("bucket")[0].as_py()
    out = []
    n = v = 0
    for kind in (1, 2):
        held = [(g, unpacked(b)) for k, g, b in zip(kinds, group, blob, strict=True) if k == kind]
        if not held:
            continue
        u, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=U64) for _, x in held]), return_inverse=True)
        count = np.bincount(at, np.concatenate([x[1] for _, x in held]), len(u)).astype(np.int64)
        if kind == 1:
            n, v = int(count.sum()), int((count > 0).sum())
        level = _levels(u << U64(16) if kind == 2 else u, count)
        low = 0
        for g, x in held:
            own = at[low : low + len(x[0])]
            out.append((bucket, g, kind, 0, 0, packed(level[own], count[own]) if kind == 1 else packed(level[own])))
            low += len(x[0])
    out.append((bucket, None, 0, n, v, None))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "group", "kind", "n", "v", "blob"])


COUNTED = "bucket int, group bigint, kind int, n bigint, v bigint, blob binary"


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group of texts: row keys, lengths and bytes of the texts."""
    for name, batch in _groups(batches):
        texts = column_texts(batch.column("text"))
        blob = packed(batch.column(KEY).to_numpy(), texts.lengths.astype(np.int64), texts.data)
        yield from _record([(-1, name, 0, blob)], ["bucket", "group", "kind", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])


def _scored(n: int, v: int):
    """One group of texts: each text's tokens, known tokens, sum of log10(c + SMOOTH) and log10 probability."""

    def run(table: pa.Table) -> pa.Table:
        # groups of the same rows share a name: what each of them sent and got is the same, and one of it is taken
        rows = {(kind, bucket): blob for kind, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True)}
        local = [unpacked(b) for (kind, _), b in rows.items() if kind == 0]
        found = [[unpacked(rows[x]) for x in sorted(rows) if x[0] == kind] for kind in (1, 2)]
        keys, lengths, data = local[0] if local else [np.zeros(0, np.int64)] * 3
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        text = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        owner, h = _tokens(pa.RecordBatch.from_arrays([text], names=["text"])) if local else (np.zeros(0, np.int64), np.zeros(0, U64))
        word, at = np.unique(h, return_inverse=True)
        pair, where = np.unique(_pair_keys(owner, h), return_inverse=True)
        level = np.concatenate([x[0] for x in found[0]] or [np.zeros(0, np.int8)])
        both = np.concatenate([x[0] for x in found[1]] or [np.zeros(0, np.int8)])
        if not local or len(level) != len(word) or len(both) != len(pair):
            raise ValueError("the texts came in another order the second time: write the table before scoring it")
        exact = np.concatenate([x[1] for x in found[0]])[at]
        count = value_of(level.astype(np.int64))
        alone = ((count + SMOOTH) / (n + SMOOTH * (v + 1)))[at]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        past = count[np.where(first, np.searchsorted(word, END), np.concatenate([at[:1], at[:-1]]))]
        ratio = np.minimum(value_of(both.astype(np.int64))[where] / np.maximum(past, 1), 1)
        weight = PAIR_WEIGHT * past / (past + FEW)
        p = weight * ratio + (1 - weight) * alone
        size = len(keys)
        return pa.table({
            KEY: pa.array(keys), "n_tokens": pa.array(np.bincount(owner, minlength=size)),
            "n_known": pa.array(np.bincount(owner, exact > 0, size).astype(np.int64)),
            "share": pa.array(np.bincount(owner, np.log10(exact + SMOOTH), size)),
            "score": pa.array(np.bincount(owner, np.log10(np.maximum(p, 1e-30)), size)),
        })

    return run


def counted(docs: DataFrame) -> DataFrame:
    """Per bucket its sums, and for each group of texts the counts and levels of its words and pairs; written once."""
    buckets = bucket_count(docs, BUCKET_BYTES)
    blobs = docs.select(key(), "held_out", "text").mapInArrow(_gather(buckets), "bucket int, group bigint, kind int, blob binary")
    return written(blobs.groupBy("bucket").applyInArrow(_count, COUNTED))


def scores(docs: DataFrame, parts: DataFrame, n: int, v: int) -> DataFrame:
    """(row key, n_tokens, n_known, share, score): counts and levels meet the texts they came from, group by group."""
    local = docs.select(key(), "held_out", "text").mapInArrow(_local, "bucket int, group bigint, kind int, blob binary")
    both = parts.filter("group is not null").select("bucket", "group", "kind", "blob").unionByName(local)
    found = both.groupBy("group").applyInArrow(_scored(n, v), f"{KEY} bigint, n_tokens bigint, n_known bigint, share double, score double")
    # rows equal in id and text may be in several groups and have the same scores in all
    return found.groupBy(KEY).agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_known", "share", "score")])


def with_held_out(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (remainder(10) == 0).alias("held_out"))


def op10(docs: DataFrame) -> DataFrame:
    rows = with_held_out(docs)
    parts = counted(rows)
    sums = parts.filter("group is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    floor = float(np.log10(n + SMOOTH * (v + 1)))
    return rows.select("doc_id", key(), "held_out").join(scores(rows, parts, n, v), KEY).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("share") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )
