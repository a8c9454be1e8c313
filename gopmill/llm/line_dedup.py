"""Removes lines that differ from an earlier line of the corpus by at most one word (inserted, left out or replaced).

Method: the deletion neighbourhood of a line is the line with each of its words left out. Two lines are within one edit
if such variants are equal, or one is a variant of the other; so variants are emitted as hashed keys, equal keys are
joined, the edit distance of what met is verified on the words, and the earliest line stays.

Variants of all lines would be as many as the words of the corpus. But one edit touches only one quarter of a line,
and the rest of both lines is equal; so hashes of what surrounds each quarter are gathered first, those of two lines
make a filter of bounded size, and only quarters that pass it emit the variants that leave out one of their words. This
loses no pair. Lines are made distinct before variants are made, so a line in every document is one row, and within a
key only the earliest line is looked up (an aggregate), never pairs.

A line's place is (doc_id, line number), documents without an id come last; a line goes if any earlier line, itself
kept or not, is within the bound. Lines are compared by their words, and the bound grows with the length: lines of one to
four words go if equal, those of EDIT_WORDS words or more also if one word differs, which is a similarity of 0.8. Lines
without a word are layout and stay. Null texts stay null. Rows equal in id and text are one document:
both lose the same lines. Other columns come back as they were, but n_chars, which follows the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, bucket_count, fresh, key
from gopmill.llm.sharedfilter import passes, shared_hashes
from gopmill.llm.textarrays import U64, Texts, mixed, powers, slices
from gopmill.session import written

EDIT_WORDS = 5
HOT_SHARE = 1000
BUCKET_BYTES = 8 << 20
PARTS = 4
WORD = r"[^\x20\x09-\x0D]+"


def part_edges(size: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before a part and words after it, for the shorter of two lines having ``size`` words."""
    return part * size // PARTS, size - (part + 1) * size // PARTS


class _Sequences:
    """Hashes of runs of words."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        power, self.inverse = powers(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(word * power[:n], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end but that at ``at``; equal to the hash of a run of just these words."""
        return self.hash(start, at) + (self.total[end] - self.total[at + 1]) * self.inverse[start + 1]


class _Lines:
    """The lines of some texts that have words: text, number, words, two hashes, and the keys of edited parts."""

    def __init__(self, texts: Texts):
        doc, low, high = texts.lines()
        _, start, end = texts.words()
        word = texts.hashes(start, end)
        first, last = np.searchsorted(start, low), np.searchsorted(start, high)
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        take = np.flatnonzero(last > first)
        self.low, self.high = low[take], high[take]
        self.doc, self.number, self.first, self.last = doc[take], number[take], first[take], last[take]
        self.one, self.two = _Sequences(word), _Sequences(mixed(word + U64(1)))
        self.h = mixed(self.one.hash(self.first, self.last)).view(np.int64)
        self.g = mixed(self.two.hash(self.first, self.last)).view(np.int64)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the lines that may be edited, and the hashes of what surrounds each of their parts.

        Columns 0 to PARTS - 1 are for a line as long as the other or shorter, the rest for a longer one.
        """
        at = np.flatnonzero(self.last - self.first >= EDIT_WORDS)
        first, last = self.first[at], self.last[at]
        keys = []
        for less in (0, 1):
            base = last - first - less
            for part in range(PARTS):
                before, after = part_edges(base, part)
                k = mixed(self.one.hash(first, first + before) + base.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(part))
                keys.append(mixed(k ^ self.one.hash(last - after, last)))
        return at, np.stack(keys, 1)


def _surroundings(batch: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    found = _Lines(texts)
    at, keys = found.around()
    return keys.reshape(-1), np.repeat(found.h[at], 2 * PARTS)


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        found = _Lines(texts)
        row = pa.array(found.doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(row), batch.column(KEY).take(row), pa.array(found.number, pa.int32()), pa.array(found.h), pa.array(found.g)],
            names=["doc_id", KEY, "number", "h", "g"],
        )


def _candidates(bloom):
    """Lines with parts whose surroundings occur in two lines, as far as the filter tells: with these parts and the text."""

    def run(batches):
        for batch, texts in slices(batches):
            found = _Lines(texts)
            at, keys = found.around()
            shared = passes(bloom.value, keys.reshape(-1)).reshape(keys.shape)
            some = np.flatnonzero(shared.any(1))
            at, shared = at[some], shared[some]
            offsets = np.concatenate([[0], np.cumsum(shared.sum(1))]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(shared)[1].astype(np.int32)))
            raw = texts.data.tobytes()
            lines = [raw[a:b].decode() for a, b in zip(found.low[at].tolist(), found.high[at].tolist(), strict=True)]
            row = pa.array(found.doc[at])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row), batch.column(KEY).take(row), pa.array(found.number[at], pa.int32()),
                    pa.array(found.h[at]), pa.array(found.g[at]), parts, pa.array(lines, pa.string()),
                ],
                names=["doc_id", KEY, "number", "h", "g", "parts", "line"],
            )

    return run


def _place():
    """Orders lines by document and number; documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(KEY).alias("row"), "number").alias("place")


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "line", 1 << 18):
        found = _Lines(texts)  # each text is one line that has words
        parts = batch.column("parts")
        owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(parts).to_numpy())
        part = pa.compute.list_flatten(parts).to_numpy().astype(np.int64)
        longer = part // PARTS
        base = (found.last - found.first)[owner] - longer
        before, after = part_edges(base, part % PARTS)
        count = base - after - before + longer
        at = np.repeat(np.arange(len(part)), count)
        place = before[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        code = np.unique(owner[at] << 32 | longer[at] << 31 | place)  # parts of a longer line overlap by a word
        line, role, place = code >> 32, code >> 31 & 1, code & 0x7FFFFFFF
        first, last = found.first[line], found.last[line]
        v = mixed(found.one.without(first, last, first + place)).view(np.int64)
        w = mixed(found.two.without(first, last, first + place)).view(np.int64)
        row = pa.array(np.concatenate([line, np.arange(batch.num_rows)]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([v, found.h])), pa.array(np.concatenate([w, found.g])),
                pa.array(np.concatenate([np.where(role == 1, -1, place), np.full(batch.num_rows, -1)]).astype(np.int32)),
                pa.array(["equal", "longer", "whole"]).take(pa.array(np.concatenate([role, np.full(batch.num_rows, 2)]))),
                batch.column("h").take(row), batch.column("g").take(row), batch.column("place").take(row),
            ],
            names=["v", "w", "tag", "role", "h", "g", "place"],
        )


def variants(candidates: DataFrame) -> DataFrame:
    """(v, w, tag, role, h, g, place): hashes of lines without one word of a shared part, and of whole lines.

    Lines of one length meet when they leave out the word at the same place (the tag); a longer line leaves out a word
    to meet a whole one.
    """
    kind = candidates.schema["place"].dataType.simpleString()
    return candidates.mapInArrow(_variants, f"v bigint, w bigint, tag int, role string, h bigint, g bigint, place {kind}")


def within_one(a: list, b: list) -> bool:
    """Is the edit distance of two sequences at most one?"""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("line").to_pylist(), batch.column("other").to_pylist(), strict=True)
        keep = pa.array([within_one(a.encode().split(), b.encode().split()) for a, b in pairs], pa.bool_())
        yield batch.select(["h", "g"]).filter(keep)


def near_lines(rows: DataFrame, buckets: int) -> DataFrame:
    """(h, g): distinct lines of ``rows(doc_id, row key, text)`` within one edit of an earlier one."""
    bloom = shared_hashes(rows, buckets, _surroundings)
    kind = f"doc_id bigint, {KEY} bigint, number int, h bigint, g bigint, parts array<int>, line string"
    found = rows.mapInArrow(_candidates(bloom), kind).select("h", "g", _place(), F.struct("parts", "line").alias("is"))
    candidates = written(found.groupBy("h", "g").agg(F.min("place").alias("place"), F.min_by("is", "place").alias("is")).select("h", "g", "place", "is.*"))
    emitted = written(variants(candidates))
    at = F.struct("place", "h", "g")
    first = emitted.groupBy("v", "w", "tag").agg(*[F.min(F.when(F.col("role") == role, at)).alias(role) for role in ("equal", "whole", "longer")])
    other = F.when(F.col("role") == "equal", F.col("equal")).when(F.col("role") == "whole", F.col("longer")).otherwise(F.col("whole"))
    met = emitted.join(first, ["v", "w", "tag"]).withColumn("other", other).filter("other.place < place")
    pairs = met.select("h", "g", F.col("other.h").alias("oh"), F.col("other.g").alias("og")).distinct()
    line = candidates.select("h", "g", "line")
    both = pairs.join(line, ["h", "g"]).join(line.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("line").alias("other")), ["oh", "og"])
    return both.select("h", "g", "line", "other").mapInArrow(_verified, "h bigint, g bigint").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """(row key, equal, near): numbers of the lines that go from each text, as equal to or within one edit of an earlier line."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key(), "text")
    every = written(rows.mapInArrow(_places, f"doc_id bigint, {KEY} bigint, number int, h bigint, g bigint").select(_place(), "h", "g"))
    near = near_lines(rows, bucket_count(docs, BUCKET_BYTES)).withColumn("near", F.lit(True))
    distinct = every.groupBy("h", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    gone = written(distinct.join(near, ["h", "g"], "left").filter("rows > 1 or near").select("h", "g", "first", "rows", F.coalesce("near", F.lit(False)).alias("near")))
    # at most HOT_SHARE lines have more than that share of all rows each: these few are broadcast, their rows stay where they are
    bound = every.count() // HOT_SHARE
    hot = F.broadcast(gone.filter(F.col("rows") > bound))
    rest = every.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(gone.filter(F.col("rows") <= bound), ["h", "g"])
    out = every.join(hot, ["h", "g"]).unionByName(rest).filter("near or place != first")
    row, at = F.col("place.row").alias(KEY), F.col("place.number")
    return out.groupBy(row).agg(F.collect_set(F.when(~F.col("near"), at)).alias("equal"), F.collect_set(F.when(F.col("near"), at)).alias("near"))


def _kept_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` without the lines numbered in ``equal`` and ``near``; the two lists come last and become counts."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts, equal, near = batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for i, text in enumerate(texts):
            if text is not None and (equal[i] or near[i]):
                drop = {*(equal[i] or ()), *(near[i] or ())}
                texts[i] = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in drop)
        columns = [*batch.columns[:-2], pa.array([len(x or ()) for x in equal], pa.int64()), pa.array([len(x or ()) for x in near], pa.int64())]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def dedup(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with duplicate lines taken out of ``text``, and the names of two more columns: lines gone as equal, as near."""
    name, equal, near = fresh(docs, KEY), fresh(docs, "_equal"), fresh(docs, "_near")
    found = removals(docs.select("doc_id", "text")).select(F.col(KEY).alias(name), F.col("equal").alias(equal), F.col("near").alias(near))
    rows = docs.withColumn(name, key()).join(found, name, "left").select(*docs.columns, equal, near)
    kinds = {equal: "bigint", near: "bigint"}
    schema = ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in rows.schema.fields)
    out = rows.mapInArrow(_kept_lines, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(equal) + F.col(near) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out, equal, near


def op4(docs: DataFrame) -> DataFrame:
    out, equal, near = dedup(docs.select("doc_id", "text"))
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("doc_id", F.col(equal).alias("n_equal_removed"), F.col(near).alias("n_near_removed"), count.cast("bigint").alias("n_lines_kept"), "text")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without duplicate lines and without the documents of which no word is left by that; columns as they came."""
    out, equal, near = dedup(docs)
    left = F.col("text").rlike(WORD)
    return out.filter((F.col(equal) + F.col(near) == 0) | left).select(*docs.columns)
