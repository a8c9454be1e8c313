"""Quality rules as a ledger: every rule is evaluated once, its outcome is a bit, policies are masks over the bits.

``ledger`` measures each text and stores one bit per failed rule. ``apply_policy`` reads bits only, so a new policy
version never touches the texts again. ``ablation`` tells by bitwise aggregation what each rule of a policy rejects,
alone and together with others.

Null and empty texts have no words: every measurement is 0 and ``few_words`` fails. Repeated rows are judged alike,
null ids are kept as they are, other columns are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gopmill.llm.common import fresh
from gopmill.llm.textarrays import U64, Texts, mixed, slices

WINDOW = 8
# fixed values: insults, as a rule's lexicon
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_insults")
# one bit each, in this order; true means that the text fails
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "upper_case": "n_letters > 0 and 2 * n_upper > n_letters",
    "insults": "n_insults > 2 and 200 * n_insults > n_words",
}
# rules of later policies; the registered query and its SQL give the bits of RULES only
LATER_RULES = {"any_insult": "n_insults > 0"}
BIT = {name: 1 << at for at, name in enumerate([*RULES, *LATER_RULES])}
# a policy is a version and the rules that reject under it
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "long_words", "short_words", "duplicate_lines"),
    "v2": tuple(RULES),
    "v3": (*RULES, *LATER_RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _measure(texts: Texts) -> dict[str, np.ndarray]:
    n, data = len(texts.lengths), texts.data
    doc, start, end = texts.words()
    blank = texts.blank()
    heads = (data & 0xC0) != 0x80
    lookup = np.zeros(256, bool)
    lookup[list(SYMBOLS)] = True
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": texts.counts(heads & ~blank),
        "n_symbols": texts.counts(lookup[data]),
        "n_upper": texts.counts((data >= 65) & (data <= 90)),
        "n_letters": texts.counts(((data | 32) >= 97) & ((data | 32) <= 122)),
    }
    # lines with a word
    line_doc, low, high = texts.lines()
    filled = np.searchsorted(start, high) > np.searchsorted(start, low)
    line_doc, low, high = line_doc[filled], low[filled], high[filled]
    salt = mixed(np.arange(n, dtype=U64))
    lines = np.unique(texts.hashes(low, high) ^ salt[line_doc], return_index=True)[1]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[lines], minlength=n)
    # words in windows found twice
    word = texts.hashes(start, end)
    repeated = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        count = len(word) - WINDOW + 1
        window = np.zeros(count, U64)
        for at in range(WINDOW):
            window = window * U64(0x9E3779B97F4A7C15) + word[at : at + count]
        whole = np.flatnonzero(doc[:count] == doc[WINDOW - 1 :])
        window = window[whole] ^ salt[doc[whole]]
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = whole[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(order) else whole
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(repeated[:-1]) > 0], minlength=n)
    # words of the lexicon, without what surrounds their letters
    low_texts = texts.lower()
    letters = ((low_texts.data >= 97) & (low_texts.data <= 122)) | (low_texts.data >= 128)
    name_doc, a, b = low_texts._spans(letters)
    lexicon = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in INSULTS])
    wanted = Texts(lexicon, np.concatenate([[0], ends])).hashes(ends - [len(w) for w in INSULTS], ends)
    short = (b - a) <= max(map(len, INSULTS))
    found = np.isin(low_texts.hashes(a[short], b[short]), wanted)
    out["n_insults"] = np.bincount(name_doc[short][found], minlength=n)
    return out


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        found = _measure(texts)
        measures = pa.StructArray.from_arrays([pa.array(found[name], pa.int64()) for name in MEASURES], list(MEASURES))
        yield pa.RecordBatch.from_arrays([*batch.columns, measures], names=[*batch.schema.names, "measured"])


def _judged(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the struct of measurements and the bits of its failed rules, and their names. One pass, no shuffle."""
    measured, failed = fresh(docs, "_quality"), fresh(docs, "_failed")
    kind = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])
    schema = T.StructType([*docs.schema.fields, T.StructField(measured, kind)])
    names = re.compile(rf"\b({'|'.join(MEASURES)})\b")
    bits = " | ".join(f"if({names.sub(measured + r'.\1', rule)}, {BIT[name]}, 0)" for name, rule in (RULES | LATER_RULES).items())

    def named(batches):
        for batch in _measured(batches):
            yield batch.rename_columns([*batch.schema.names[:-1], measured])

    return docs.mapInArrow(named, schema).withColumn(failed, F.expr(bits).cast("int")), measured, failed


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bit per rule in the order of RULES and LATER_RULES."""
    judged, measured, failed = _judged(docs.select("doc_id", "text"))
    return judged.select("doc_id", f"{measured}.*", F.col(failed).alias("failed"))


def apply_policy(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``kept``: none of the policy's bits is set."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(mask(policy)) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail it, that fail it alone, and the other rules seen failing beside it."""
    rows = []
    for policy, names in POLICIES.items():
        m = mask(policy)
        for name in names:
            b = BIT[name]
            hit = F.col("failed").bitwiseAND(b) != 0
            rows += [
                F.count(F.when(hit, 1)).alias(f"{policy}:{name}:failing"),
                F.count(F.when(F.col("failed").bitwiseAND(m) == b, 1)).alias(f"{policy}:{name}:alone"),
                F.coalesce(F.bit_or(F.when(hit, F.col("failed").bitwiseAND(m & ~b))), F.lit(0)).alias(f"{policy}:{name}:beside"),
            ]
    one = entries.agg(*rows)
    parts = ", ".join(
        f"named_struct('policy', '{policy}', 'rule', '{name}', "
        + ", ".join(f"'{k}', cast(`{policy}:{name}:{k}` as bigint)" for k in ("failing", "alone", "beside")) + ")"
        for policy, names in POLICIES.items() for name in names
    )
    return one.select(F.expr(f"inline(array({parts}))"))


def op9(docs: DataFrame, policy: str = "v2") -> DataFrame:
    judged = apply_policy(ledger(docs), policy)
    base = F.col("failed").bitwiseAND(mask("base")) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.when(base, False).otherwise(F.col("kept")).alias("kept"), F.col("failed").bitwiseAND(sum(BIT[name] for name in RULES)).alias("failed_bits"),
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """``docs`` without the rows that the policy rejects, columns as they came."""
    judged, _, failed = _judged(docs)
    return judged.filter(F.col(failed).bitwiseAND(mask(policy)) == 0).select(*docs.columns)


ORACLE = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i : i + 7] AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
often AS (SELECT doc_id, words FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows JOIN often USING (doc_id, words)) GROUP BY doc_id),
lined AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.again, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+'),
      lambda x: x IN (INSULTS))) AS n_insults
  FROM split s LEFT JOIN lined l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, CAST((BITS) AS INTEGER) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM judged
""".replace("INSULTS", ", ".join(f"'{w}'" for w in INSULTS)).replace("BITS", " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items()))
