"""Language of every word and text by a linear-chain conditional random field.

A word's score in each language is the sum of the weights of its features: its character n-grams of length 2 to 4 with
marks at both ends (so they hold prefixes and suffixes), and the word itself if it is in the lexicon. Neighbouring words
are tied by learned transitions, and forward-backward gives each word's probability of each language, so that text
which switches language is labelled word by word. A text's language is that of the largest summed probability.

The model is fitted on the driver on a bounded sample: about DOCS_PER_LANG labelled texts of each language, chosen by
hash over all that may be learned from; whole texts. They are joined to one sequence in random order, so that switches
of language occur in it. What is broadcast is 2^FEATURE_BITS weights a language and the sample's lexicon. Prediction is
one pass over all texts without a shuffle. Sequences are worked through in parallel pieces: each piece's product of
transitions and scores tells what enters the next.

Words are runs of letters (A-Z, a-z and all beyond ASCII), in lower case. A text that is null or has no letter is ``und``
with score 0, and so is every text if nothing can be learned from. Null ids count as '' and are held out. Repeated rows
are predicted alike. Rows without lang are predicted, not learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gopmill.llm.common import key, remainder
from gopmill.llm.textarrays import U64, Texts, column_texts, mixed, slices

DOCS_PER_LANG = 200
MAX_LANGS = 1000
FEATURE_BITS = 16
GRAMS = (2, 3, 4)
STEPS = 30
RATE = 0.3
PIECES = 512


class Words:
    """Words of several texts and the features of the distinct ones."""

    def __init__(self, texts: Texts):
        data = texts.data
        letters = (data >= 128) | ((data >= 97) & (data <= 122))
        self.doc, start, end = texts._spans(letters)
        names = texts.hashes(start, end)
        self.name, first, self.at = np.unique(names, return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        # each distinct word between marks
        size = end - start + 2
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        marked = np.full(self.offsets[-1], ord("^"), np.uint8)
        inner = np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1], size)
        body = (inner > 0) & (inner < np.repeat(size, size) - 1)
        marked[body] = data[np.repeat(start, size)[body] + inner[body] - 1]
        marked[self.offsets[1:] - 1] = ord("$")
        self.features, self.owner = [], []
        view = Texts(marked, self.offsets)
        owner = np.repeat(np.arange(len(size)), size)
        for n in GRAMS:
            at = np.flatnonzero(inner + n <= np.repeat(size, size))
            h = view.hashes(at, at + n)
            self.features.append((mixed(h + U64(n)) >> U64(64 - FEATURE_BITS)).astype(np.int64))
            self.owner.append(owner[at])
        self.features, self.owner = np.concatenate(self.features), np.concatenate(self.owner)

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the feature weights of each distinct word."""
        return np.stack([np.bincount(self.owner, weights[self.features, k], len(self.name)) for k in range(weights.shape[1])], 1)

    def gathered(self, slope: np.ndarray) -> np.ndarray:
        """What each feature's weight gets of the words' slopes."""
        return np.stack([np.bincount(self.features, slope[self.owner, k], 1 << FEATURE_BITS) for k in range(slope.shape[1])], 1)


def forward_backward(scores: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each place, and the expected number of each step.

    ``scores`` are logarithms, ``first`` marks places where a new sequence starts, ``start`` and ``step`` are the
    factors of a first label and of a step between labels.
    """
    n, k = scores.shape
    pieces = max(1, min(PIECES, n // 8))
    size = -(-n // pieces)
    total = pieces * size
    e = np.ones((total, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    new = np.zeros(total, bool)
    new[:n] = first
    new[n:] = True
    e, new = e.reshape(pieces, size, k), new.reshape(pieces, size)

    # what each piece makes of any label before it
    product = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
    for t in range(size):
        moved = product @ step
        if new[:, t].any():
            at = new[:, t]
            moved[at] = product[at].sum(2, keepdims=True) * start
        product = moved * e[:, t, None, :]
        product /= product.sum((1, 2), keepdims=True)
    enter = np.empty((pieces, k))
    enter[0] = 1 / k
    for p in range(1, pieces):
        v = enter[p - 1] @ product[p - 1]
        enter[p] = v / v.sum()
    leave = np.empty((pieces, k))
    leave[-1] = 1
    for p in range(pieces - 1, 0, -1):
        v = product[p] @ leave[p]
        leave[p - 1] = v / v.sum()

    alpha, beta = np.empty_like(e), np.empty_like(e)
    before = np.empty_like(e)
    a = enter
    for t in range(size):
        before[:, t] = a
        moved = np.where(new[:, t, None], start, a @ step)
        a = moved * e[:, t]
        a = a / a.sum(1, keepdims=True)
        alpha[:, t] = a
    b = leave
    for t in range(size - 1, -1, -1):
        beta[:, t] = b
        ahead = b * e[:, t]
        b = np.where(new[:, t, None], 1.0, ahead @ step.T)
        b = b / b.sum(1, keepdims=True)
    label = (alpha * beta).reshape(total, k)[:n]
    label /= label.sum(1, keepdims=True)
    inside = ~new.reshape(total)[:n]
    after = (e * beta).reshape(total, k)[:n][inside]
    behind = before.reshape(total, k)[:n][inside]
    scale = np.einsum("ni,ij,nj->n", behind, step, after)
    steps = (behind / scale[:, None]).T @ after * step
    return label, steps


class Model:
    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.weights = np.zeros((1 << FEATURE_BITS, k))
        self.lexicon, self.words = np.zeros(0, U64), np.zeros((0, k))
        self.start, self.step = np.zeros(k), np.zeros((k, k))

    def fit(self, texts: Texts, lang: np.ndarray) -> Model:
        """Full-batch gradient steps, each weight's rate falling with its past slopes."""
        words, k = Words(texts), len(self.langs)
        if not len(words.at):
            return self
        # lexicon: words of two texts of the sample
        pairs = np.unique(words.at * len(lang) + words.doc)
        common = np.flatnonzero(np.bincount(pairs // len(lang), minlength=len(words.name)) > 1)
        self.lexicon, self.words = words.name[common], np.zeros((len(common), k))
        truth = np.eye(k)[lang[words.doc]]
        first = np.zeros(len(words.at), bool)
        first[0] = True
        seen = truth[:-1].T @ truth[1:]
        past = [np.full_like(x, 1e-6) for x in (self.weights, self.words, self.start, self.step)]
        rows = len(words.at)
        for _ in range(STEPS):
            each = words.spread(self.weights)
            each[common] += self.words
            label, steps = forward_backward(each[words.at], first, np.exp(self.start), np.exp(self.step))
            wrong = (truth - label) / rows
            slope = np.stack([np.bincount(words.at, wrong[:, j], len(words.name)) for j in range(k)], 1)
            slopes = (words.gathered(slope), slope[common], wrong[0], (seen - steps) / rows)
            for x, s, p in zip((self.weights, self.words, self.start, self.step), slopes, past, strict=True):
                p += s * s
                x += RATE * s / np.sqrt(p)
        return self

    def labels(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text and language probabilities of each word."""
        words = Words(texts)
        if not len(words.at) or not self.langs:
            return words.doc[:0], np.zeros((0, len(self.langs)))
        each = words.spread(self.weights)
        if len(self.lexicon):
            where = np.minimum(np.searchsorted(self.lexicon, words.name), len(self.lexicon) - 1)
            known = self.lexicon[where] == words.name
            each[known] += self.words[where[known]]
        first = np.concatenate([[True], words.doc[1:] != words.doc[:-1]])
        label, _ = forward_backward(each[words.at], first, np.exp(self.start), np.exp(self.step))
        return words.doc, label


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    columns = list(batch.columns)
    columns[at] = pc.utf8_lower(columns[at])
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> Model:
    """A model of the languages in ``docs(doc_id, text, lang)``; two jobs, the second brings the sample."""
    labelled = docs.filter("lang is not null and text is not null")
    counts = {r.lang: r.rows for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    langs = sorted(counts)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages, more than {MAX_LANGS}")
    if not langs:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / counts[lang]))])
    chance = F.pmod(key(), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(chance < share[F.col("lang")]).select("text", "lang", key()).toArrow().to_pandas()
    sample = sample.sort_values(sample.columns[2]).reset_index(drop=True)  # by hash: as good as random, always the same
    texts = column_texts(pc.utf8_lower(pa.array(sample["text"], pa.string())))
    return Model(langs).fit(texts, sample["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(np.int64))


def _predict(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        fitted = model.value
        for batch, texts in slices(map(lowered, batches)):
            n = batch.num_rows
            doc, label = fitted.labels(texts)
            total = np.stack([np.bincount(doc, label[:, j], n) for j in range(label.shape[1])], 1) if len(fitted.langs) else np.zeros((n, 1))
            ascii_letters = texts.counts((texts.data >= 97) & (texts.data <= 122)) > 0
            best, words = total.argmax(1), np.bincount(doc, minlength=n)
            langs, scores = [], []
            raw = batch.column("text")
            for i in range(n):
                if fitted.langs and words[i] and (ascii_letters[i] or any(c.isalpha() for c in raw[i].as_py())):
                    langs.append(fitted.langs[best[i]])
                    scores.append(min(1.0, total[i, best[i]] / words[i]))
                else:
                    langs.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def _runs(model):
    def run(batches):
        for batch, texts in slices(map(lowered, batches)):
            doc, label = model.value.labels(texts)
            best = label.argmax(1) if len(doc) else doc
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])])) if len(doc) else doc
            size = np.diff(np.concatenate([starts, [len(doc)]]))
            langs = np.array(model.value.langs, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc[starts])), pa.array(number[starts], pa.int64()), pa.array(size, pa.int64()), pa.array(langs[best[starts]].tolist() if len(starts) else [], pa.string())],
                names=["doc_id", "first_word", "n_words", "lang"],
            )

    return run


def word_runs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, n_words, lang: runs of words in one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_runs(shared), "doc_id bigint, first_word bigint, n_words bigint, lang string")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs(doc_id, text, held_out)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text").mapInArrow(
        _predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def op6(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    return predict(rows, train(rows.filter(~F.col("held_out"))))
