"""Packing into length buckets whose boundaries waste the least padding, then into batches of a token budget.

Every text in a bucket is padded to the bucket's boundary. The boundaries come from dynamic programming over the global
histogram of lengths and are optimal at every size. The driver holds the histogram, one row per distinct length, so at
most as many as the longest text has words, whatever the number of texts; the programming takes time linear in them.

Batches: a bucket of boundary b takes budget // b texts a batch (one, if a text is longer than the budget). A bucket may
hold any share of all rows; it is cut by a hash into shards of about SHARD_ROWS texts, rows are numbered in a shard, and a
batch is a run of numbers. Only the last batch of a shard may be short.

Length is the number of words (runs without blanks); null and empty texts have length 0 and are packed like others.
Repeated rows are packed as often as they occur. With no rows there are no buckets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import key
from gopmill.session import written

BUCKETS = 16
BUDGET = 65536
MAX_BINS, EXACT_BELOW = 4096, 1024  # without effect: lengths are never rounded; tests of the former bounds set them
SHARD_ROWS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths and how many texts have them. ``lengths(n_tokens)``."""
    rows = sorted((r.n_tokens, r.rows) for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, increasing, of least total padding; the last one is the greatest length.

    best[j] is the least of boundary * texts, summed over the buckets of the first j lengths; a last bucket from i to j
    costs lengths[j] * texts(i..j). So each i is a line in lengths[j], of falling slope, and as lengths rise, the best i
    moves along the lower hull of the lines. Whole numbers, so nothing is rounded.
    """
    n = len(lengths)
    if not n:
        return []
    size, texts = lengths.tolist(), [0, *np.cumsum(counts).tolist()]
    # padding is boundary * texts less all tokens, and the tokens are the same for every choice
    best, cuts = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        step, cut, hull, head = [0] * (n + 1), np.zeros(n + 1, np.int64), [], 0
        for j in range(1, n + 1):
            c, t = best[j - 1], texts[j - 1]
            if c is not None:
                while len(hull) - head > 1:
                    (_, t1, c1), (_, t2, c2) = hull[-2:]
                    if (c2 - c1) * (t - t1) < (c - c1) * (t2 - t1):
                        break
                    hull.pop()
                hull.append((j - 1, t, c))
            x = size[j - 1]
            while len(hull) - head > 1 and hull[head + 1][2] - x * hull[head + 1][1] < hull[head][2] - x * hull[head][1]:
                head += 1
            at, t, c = hull[head]
            cut[j], step[j] = at, c + x * (texts[j] - t)
        cuts.append(cut)
        best = step
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch (unique string), slot in the batch, padding."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = written(docs.select("doc_id", size.alias("n_tokens"), key().alias("row")))  # texts are read once
    lengths, counts = histogram(sized.select("n_tokens"))
    edges = boundaries(lengths, counts, buckets)
    held, low = [], 0
    for edge in edges:
        high = int(np.searchsorted(lengths, edge, side="right"))
        held.append(int(counts[low:high].sum()))
        low = high
    # the few boundaries are part of the plan
    bucket = F.lit(len(edges) - 1) if edges else F.lit(0)
    for at in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[at], F.lit(at)).otherwise(bucket)
    per_bucket = lambda values: F.element_at(F.array(*[F.lit(v) for v in values or [0]]).cast("array<bigint>"), F.col("bucket") + 1)
    shards = [max(1, -(-rows // SHARD_ROWS)) for rows in held]
    placed = sized.withColumn("bucket", bucket).withColumn("boundary", per_bucket(edges)).withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "row"), per_bucket(shards)))
    # rows equal in hash are copies of one document: which of them comes first makes no difference
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row", "doc_id")) - 1
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))), F.lit(1))
    numbered = placed.withColumn("number", number).withColumn("in_batch", per_batch)
    return numbered.select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "boundary",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("number") / F.col("in_batch"))).alias("batch"),
        (F.col("number") % F.col("in_batch")).cast("bigint").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
