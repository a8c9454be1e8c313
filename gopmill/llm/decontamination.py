"""Benchmark decontamination by a distributed positional inverted index over the training texts.

A benchmark item is cut into phrases of ten words (an item of fewer words is one phrase). ``postings`` stores, for the
terms asked for, each occurrence in the training texts: term, text, position, and for a phrase's rarest term also the
words around it. ``candidates`` starts from the list of each phrase's rarest term, turned into phrase starts by taking
off the term's offset, and intersects it with the equally shifted list of the second rarest. Phrases whose rarest term
never occurs are gone by then. The index also holds the length of each text, so no further pass counts its words. ``phrase_matches`` compares the remaining terms with the stored neighbours, so matches
are exact; ``proximity_matches`` asks only that all terms of a phrase lie around its rarest one, in any order.

The benchmark's terms are broadcast in blocks of at most MAX_TERMS, one pass over the texts for each block, so a table
held in memory has a fixed bound and texts are never shuffled. Only postings are, spread by term, text and position.

Null and empty texts have no words, and no hits. An item without words or without an id is left out. Items with the
same id count once; rows of documents equal in id and text have equal results. With no items, or no documents,
nothing is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, fresh, key
from gopmill.session import written

PHRASE = 10
MAX_TERMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the same as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, with the most frequent characters first
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
LENGTH = " "  # no word: the term under which the index holds a text's number of words, as a position


def words(text: Column) -> Column:
    """Words with A-Z in lower case; other capitals stay, which lower() would not leave alone beyond ASCII."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def phrases(items: DataFrame) -> DataFrame:
    """(phrase, items): the distinct phrases, words joined by blanks, each with the ids of its items."""
    cut = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (PHRASE - 1), F.lit(1)))
    each = cut.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("s"))
    joined = each.select("item", F.concat_ws(" ", F.slice("w", F.col("s"), F.lit(PHRASE))).alias("phrase"))
    return joined.groupBy("phrase").agg(F.collect_set("item").alias("items"))


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The table of terms in parts small enough to broadcast."""
    parts = -(-terms.count() // MAX_TERMS)
    return [F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)) for part in range(max(parts, 1))]


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` in all texts, those that occur."""
    each = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return reduce(DataFrame.unionByName, [each.join(part, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for part in _blocks(terms)])


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row key, pos, near, near_at) of ``terms(term, rarest)``; ``near`` are the words up to nine places away.

    LENGTH is found at the end of every text. The neighbours are one string, words joined by blanks.
    """
    cut = docs.select(key(), words(F.col("text")).alias("w"))
    each = cut.select(KEY, "w", F.posexplode(F.concat("w", F.array(F.lit(LENGTH)))).alias("pos", "term"))
    low = F.greatest(F.col("pos") - (PHRASE - 1), F.lit(0))
    near = F.concat_ws(" ", F.slice("w", low + 1, F.col("pos") - low + PHRASE))
    found = [
        each.join(part, "term").select("term", KEY, "pos", F.when(F.col("rarest"), near).alias("near"), low.alias("near_at")) for part in _blocks(terms)
    ]
    return reduce(DataFrame.unionByName, found)


def rarest_terms(sought: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, term, at, other, other_at): the two rarest distinct terms of each phrase and their first offsets."""
    each = sought.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    first = each.groupBy("phrase", "term").agg(F.min("at").alias("at"))
    counted = first.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("phrase").orderBy("n", "term")  # ten rows at most
    ranked = counted.withColumn("rank", F.row_number().over(order)).withColumn("other", F.lead("term").over(order)).withColumn("other_at", F.lead("at").over(order))
    return ranked.filter("rank = 1 and n > 0").select("phrase", "term", "at", "other", "other_at")


class Index:
    """The postings that the phrases of a benchmark need, written once."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        self.phrases = written(phrases(items))
        terms = self.phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
        self.rarest = written(rarest_terms(self.phrases, frequencies(docs, written(terms))))
        chosen = self.rarest.select("term", F.lit(True).alias("rarest")).unionByName(
            self.rarest.filter("other is not null").select(F.col("other").alias("term"), F.lit(False).alias("rarest"))
        )
        length = docs.sparkSession.range(1).select(F.lit(LENGTH).alias("term"), F.lit(False).alias("rarest"))
        asked = chosen.groupBy("term").agg(F.max("rarest").alias("rarest")).unionByName(length)
        self.postings = written(postings(docs, written(asked)))

    def lengths(self) -> DataFrame:
        """(row key, n_words) of the texts that are not null."""
        return self.postings.filter(F.col("term") == LENGTH).groupBy(KEY).agg(F.max("pos").cast("bigint").alias("n_words"))

    def anchored(self) -> DataFrame:
        """Each phrase at each occurrence of its rarest term: (row key, phrase, start, ...)."""
        lists = self.postings.filter("near is not null").join(self.rarest, "term")
        return lists.select(KEY, "phrase", (F.col("pos") - F.col("at")).alias("start"), "near", "near_at", "other", "other_at")

    def candidates(self) -> DataFrame:
        """Phrase starts in both of the phrase's offset-adjusted lists."""
        first = self.anchored().filter("start >= 0").withColumn("other_pos", F.col("start") + F.col("other_at"))
        second = self.postings.select(F.col(KEY), F.col("term").alias("other"), F.col("pos").alias("other_pos"))
        both = first.filter("other is not null").join(second, [KEY, "other", "other_pos"], "left_semi")
        return both.unionByName(first.filter("other is null"))

    def phrase_matches(self) -> DataFrame:
        """(row key, phrase, start, size) of every exact occurrence."""
        size = F.size(F.split("phrase", " "))
        there = F.slice(F.split("near", " "), F.greatest(F.col("start") - F.col("near_at") + 1, F.lit(1)), size)
        return self.candidates().filter(there == F.split("phrase", " ")).select(KEY, "phrase", "start", size.alias("size"))

    def proximity_matches(self) -> DataFrame:
        """(row key, phrase): all terms of the phrase within nine words of its rarest one, whatever their order."""
        missing = F.array_except(F.split("phrase", " "), F.split("near", " "))
        return self.anchored().filter(F.size(missing) == 0).select(KEY, "phrase").distinct()


def covered(spans: Column) -> Column:
    """Words inside the union of sorted (start, size) spans."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))

    def step(state, span):
        end = span["start"] + span["size"]
        more = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + more).alias("total"))

    return F.aggregate(spans, begin, step, lambda state: state["total"])


def hits(index: Index) -> DataFrame:
    """(row key, n_hit, items): of texts with a match."""
    exact = written(index.phrase_matches())
    spans = exact.groupBy(KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    ids = exact.select(KEY, "phrase").distinct().join(index.phrases, "phrase").select(KEY, F.explode("items").alias("item"))
    found = ids.groupBy(KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(found, KEY).select(KEY, covered(F.col("spans")).alias("n_hit"), "items")


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    index = Index(docs, items)
    found = index.lengths().join(hits(index), KEY, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        docs.select("doc_id", key()).join(found, KEY, "left").select(
            "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a phrase of the benchmark, columns as they came."""
    name = fresh(docs, KEY)
    found = hits(Index(docs.select("doc_id", "text"), items)).filter("n_hit > 0").select(F.col(KEY).alias(name))
    return docs.withColumn(name, key()).join(found, name, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
cut AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS phrase, len(w[s : s + 9]) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM cut WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
grams AS (
  SELECT doc_id, s, size, w[s : s + size - 1] AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM words, sizes WHERE len(w) >= size)),
matches AS (SELECT DISTINCT doc_id, s, g.size, p.item_id FROM grams g JOIN phrases p ON g.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM matches) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id),
lengths AS (SELECT doc_id, len(w) AS n_words FROM words)
SELECT n.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lengths n LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""
