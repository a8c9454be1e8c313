"""Interval and point-in-interval joins within equal keys.

An equality on the keys plus a range predicate compares every pair of a key. Here intervals are listed in an index of
cells whose width grows eightfold from level to level, ``width`` at level 0. An interval belongs to the lowest level at
which it spans at most CELLS cells, and is listed under those; it is listed under the cells of a higher level, two at
most, where some interval of the other side belongs to that level. So an interval of any length is a few rows: what it
costs does not grow with its length. Two intervals meet at the higher of their two levels, in the first cell they share
there, so each pair appears once; the original predicate stays as a residual. Which levels a side has is one number, an
aggregate of bits that Spark computes as a subquery before the join; where no interval is long the index is one grid.

A frequent cell is left to the adaptive skew join. With ``rows_per_task`` set, cells that hold more rows of the larger side
are split by a salt and the other side is repeated there; that counts the larger side once more, so it suits stored tables.
Between two sides of intervals a cell is split by its pairs as well, since many long intervals and all that lies in them meet
in one; that counts both sides. What a pair must know of its cell is worked out for each listed row, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
PAIRS_PER_TASK = 1 << 23
CELL, LEVELS_HERE, SALT = "_cell", "_levels", "_salt"
LEFT_PLACE, RIGHT_PLACE = "_left_place", "_right_place"
OWN_LEVEL, FIRST_CELL = 1, 2
CELLS = 8
GROWTH = 8
# Positions are held within 2^56 cells of level 0, so that a cell's number and its level fit into 64 bits.
FARTHEST = 2.0**56
LEVELS = 20
TAG = 32


class _Span:
    """An interval in the index: where it begins and ends, and the level it belongs to. Either end may be the lower."""

    def __init__(self, start: Column, end: Column, width: float):
        self.width = float(width)
        limit = F.lit(self.width * FARTHEST)
        start, end = start.cast("double"), end.cast("double")
        low, high = F.least(start, end), F.greatest(start, end)
        # an end that is no number is as far as can be, as it is in comparisons; without any end there is no interval
        self.low = F.when(low.isNotNull(), F.least(F.greatest(low, -limit), limit))
        self.high = F.when(low.isNotNull(), F.least(F.greatest(high, -limit), limit))
        cells = (self.high - self.low) / self.width
        steps = F.ceil(F.log2(cells / CELLS) / math.log2(GROWTH)).cast("int")
        self.level = F.when(cells <= CELLS, F.lit(0)).otherwise(F.greatest(steps, F.lit(1)))

    def _cell(self, at: Column, level: Column) -> Column:
        wide = F.lit(self.width) * F.pow(F.lit(float(GROWTH)), level)
        return F.floor(at / wide).cast("bigint") * TAG + level

    def first(self, level: Column) -> Column:
        return self._cell(self.low, level)

    def cells(self, level: Column) -> Column:
        """Array of the cells of a level that the interval touches."""
        return F.sequence(self.first(level), self._cell(self.high, level), F.lit(TAG).cast("bigint"))

    def listing(self, others: Column) -> Column:
        """Array of all cells to list it under; ``others`` has a bit for each level the other side's intervals belong to."""
        own = self.cells(self.level)
        levels = F.filter(
            F.sequence(F.lit(1), F.lit(LEVELS)),
            lambda n: (n > self.level) & (others.bitwiseAND(F.pow(F.lit(2.0), n).cast("bigint")) != 0),
        )
        higher = F.flatten(F.transform(levels, lambda n: self.cells(n)))
        return F.when(others > 1, F.concat(own, higher)).otherwise(own)

    def place(self, cell: Column) -> Column:
        """Bits for a cell it is listed under: whether it belongs to the cell's level, whether the cell is its first there."""
        level = cell.bitwiseAND(TAG - 1)
        own = F.when(level == self.level, OWN_LEVEL).otherwise(0)
        return own + F.when(cell == self.first(level), FIRST_CELL).otherwise(0)


def _listed(df: DataFrame, span: _Span, others: Column) -> DataFrame:
    """A row for each cell to list a row of ``df`` under."""
    return df.withColumn(LEVELS_HERE, others).withColumn(CELL, F.explode(span.listing(F.col(LEVELS_HERE)))).drop(LEVELS_HERE)


def _levels(df: DataFrame, span: _Span) -> Column:
    """Bits of the levels that the intervals of ``df`` belong to, as a subquery."""
    bit = F.pow(F.lit(2.0), span.level).cast("bigint")
    return df.agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias(LEVELS_HERE)).scalar()


def spread_hot(
    big: DataFrame, small: DataFrame, on: Sequence[str], rows_per_task: int | None = ROWS_PER_TASK
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt that splits the join keys too frequent in ``big``.

    ``big`` rows of such a key are dealt out
    over ceil(count / rows_per_task) salts; ``small`` rows are repeated once per salt.
    """
    if rows_per_task is None:
        return big, small, list(on)
    ways = F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int")
    return _dealt(big, small, on, big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).select(*on, ways.alias("_ways")))


def _spread_pairs(big: DataFrame, small: DataFrame, on: Sequence[str], rows_per_task: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """As ``spread_hot``, and a key of more than PAIRS_PER_TASK pairs is dealt out over as many salts as that makes."""
    if rows_per_task is None:
        return big, small, list(on)
    rows = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    others = small.groupBy(*on).agg(F.count(F.lit(1)).alias("_m"))
    pairs = F.col("_n").cast("double") * F.coalesce("_m", F.lit(0))
    ways = F.greatest(F.ceil(F.col("_n") / F.lit(rows_per_task)), F.least(F.ceil(pairs / F.lit(PAIRS_PER_TASK)), F.col("_n")))
    return _dealt(big, small, on, rows.join(others, list(on), "left").select(*on, ways.cast("int").alias("_ways")))


def _dealt(big: DataFrame, small: DataFrame, on: Sequence[str], ways: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt, of which a key has as many as ``ways`` tells."""
    hot = ways.where(F.col("_ways") > 1)
    # few rows, but as many more as ``big`` has: whether they are broadcast is left to their size
    # a hash of the row, not a random number: a recomputed task must deal its rows out the same way
    dealt = (
        big.join(hot, list(on), "left")
        .withColumn(SALT, F.pmod(F.xxhash64(*big.columns), F.coalesce(F.col("_ways"), F.lit(1))).cast("int"))
        .drop("_ways")
    )
    repeated = (
        small.join(hot, list(on), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ways"), F.lit(1)) - 1)))
        .drop("_ways")
    )
    return dealt, repeated, [*on, SALT]


def overlap_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    big_span: tuple[str, str],
    small_span: tuple[str, str],
    width: float,
    predicate: Column,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Pairs of intervals that satisfy ``predicate`` (which must imply that they touch).

    Column names of the two sides must differ but for the keys. Zero-length and reversed intervals are covered:
    cells run from the lower to the higher end.
    """
    left_span = _Span(*[F.col(c) for c in big_span], width)
    right_span = _Span(*[F.col(c) for c in small_span], width)
    left = _listed(big, left_span, _levels(small, right_span)).withColumn(LEFT_PLACE, left_span.place(F.col(CELL)))
    right = _listed(small, right_span, _levels(big, left_span)).withColumn(RIGHT_PLACE, right_span.place(F.col(CELL)))
    left, right, on = _spread_pairs(left, right, [*keys, CELL], rows_per_task)
    if rows_per_task is not None:
        left = left.repartition(*on)  # pairs are dealt out also where the other side is broadcast
    # the level is the higher of the two, and no cell before this one is shared there
    meet = F.col(LEFT_PLACE).bitwiseOR(F.col(RIGHT_PLACE)) == OWN_LEVEL + FIRST_CELL
    return left.join(right, on).where(meet & predicate).drop(CELL, SALT, LEFT_PLACE, RIGHT_PLACE)


def point_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: Column,
    span: tuple[Column, Column],
    width: float,
    predicate: Column,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Points with the intervals that satisfy ``predicate``; ``span`` must contain every point it accepts.

    Pass ``rows_per_task=None`` where a cell is bounded anyway (dense frame numbers).
    """
    spanned = _Span(*span, width)
    left = _listed(points, _Span(at, at, width), _levels(spans, spanned))
    # a point belongs to level 0, so a pair meets at the level of the interval and nowhere else
    right = spans.withColumn(CELL, F.explode(spanned.cells(spanned.level)))
    left, right, on = spread_hot(left, right, [*keys, CELL], rows_per_task)
    return left.join(right, on).where(predicate).drop(CELL, SALT)
