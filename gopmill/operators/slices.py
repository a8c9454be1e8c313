"""Ordered computations over groups of any size.

A window over a whole group runs in one task, and one asset or job may hold a third of all rows. So a group is
cut into slices along its order: each slice is reduced with an ordinary (map-side combined) aggregate, the few
slice rows are windowed to find what each slice inherits, and the rows themselves only ever meet windows over
(group, slice). ``slice_by`` must not decrease along the order, e.g. ``packet_idx div 65536``. Rows with a null key are
one group, rows with a null position the first slice of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gopmill.session import written

SLICE = "_slice"
SLICE_ROWS = 65536
# Quantiles taken of a group that is cut by its rows, and the most slices made of them: half as many, so that rounding a
# slice to whole cuts keeps it under twice its rows.
CUTS = 4096
SLICES = CUTS // 2
# Spark's own bound for limits within windows, and the parts a group is dealt out to beyond it.
LIMITED, TOP_PARTS = 1000, 64


def slice_of(column: str, rows: int = SLICE_ROWS) -> Column:
    """Slice number of a dense integer position: at most ``rows`` rows a slice."""
    return F.call_function("div", F.col(column), F.lit(rows))


def inherit(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    summaries: Sequence[Column],
    carries: Callable[[WindowSpec], Sequence[Column]],
) -> DataFrame:
    """``df`` with its slice and what that slice inherits from the others of its group.

    ``summaries`` are aggregates per slice; ``carries`` turns the window over a group's slices into columns
    computed from those summaries.
    """
    sliced = df.withColumn(SLICE, slice_by)
    per_slice = sliced.groupBy(*keys, SLICE).agg(*summaries)
    over_slices = Window.partitionBy(*keys).orderBy(SLICE)
    inherited = per_slice.select(*keys, SLICE, *carries(over_slices))
    # the rows are shuffled by (keys, slice) once, for this join and the windows above it, and sorted once
    return join_null_safe(sliced, inherited, [*keys, SLICE])


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names where nulls meet nulls, so a row without a key or a position stays."""
    renamed = {name: f"_of_right_{at}" for at, name in enumerate(names)}
    other = right.withColumnsRenamed(renamed)
    return left.join(other, reduce(and_, [F.col(n).eqNullSafe(F.col(r)) for n, r in renamed.items()]), how).drop(*renamed.values())


def sliced_by_rows(df: DataFrame, keys: Sequence[str], position: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with its slice, where integer positions may lie far apart: a group of up to ``rows`` rows is one slice.

    A larger group is cut where its own positions lie, by a quantile sketch: CUTS cuts of about equal depth, of which
    every so manieth ends a slice, so that a slice holds less than twice ``rows`` rows whatever the positions are. Sketches
    merge, so they are built before the shuffle. Beyond SLICES slices a group's slices grow with it. Rows of one position
    are in one slice. Only the groups that are cut come back to the rows, at most one for every ``rows`` rows; whether there
    is any is counted at once, as without them the rows need no join.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows)
    if sizes.isEmpty():
        return df.withColumn(SLICE, F.lit(0).cast("bigint"))
    large = join_null_safe(df.select(*keys, F.col(position).cast("bigint").alias("_position")), sizes, keys)
    depths = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = large.groupBy(*keys).agg(
        F.percentile_approx("_position", depths, F.lit(CUTS * 4)).alias("_cuts"),
        F.least(F.ceil(F.max("_rows") / rows), F.lit(SLICES)).alias("_slices"),
    )
    placed = join_null_safe(df, cuts, keys, "left")
    passed = cuts_passed(F.col("_cuts"), F.col(position).cast("bigint"))
    slice_ = F.ceil((passed + 1) * F.col("_slices") / CUTS) - 1  # a slice ends at the last cut that is not past its share
    return placed.withColumn(SLICE, F.coalesce(slice_, F.lit(0).cast("bigint"))).drop("_cuts", "_slices")


def cuts_passed(cuts: Column, position: Column, cells: int = CUTS) -> Column:
    """How many of a sorted array of ``cells`` - 1 cuts lie below ``position``, found in two steps of a root of it each."""
    step = math.isqrt(cells)

    def below(part: Column) -> Column:
        return F.size(F.filter(part, lambda cut: cut < position))

    landmarks = F.transform(F.sequence(F.lit(step), F.lit(cells - step), F.lit(step)), lambda i: F.element_at(cuts, i.cast("int")))
    start = below(landmarks) * step
    return F.when(cuts.isNotNull() & position.isNotNull(), start + below(F.slice(cuts, start + 1, F.lit(step))))


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group in a unique order, with their place under ``name``.

    Up to LIMITED rows Spark keeps no more than that a task before it shuffles. For more, a group is dealt out to TOP_PARTS
    parts first, each of which keeps its first ``n``; so the window over a group sees a bounded number of its rows.
    """
    if n > LIMITED:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(TOP_PARTS))
        of_part = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
        df = df.withColumn("_part", part).withColumn(name, of_part).where(F.col(name) <= n).drop("_part", name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col(name) <= n)


def in_slice(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def after(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(1, Window.unboundedFollowing)


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per group."""
    valued = df.withColumn("_value", value)
    carried = inherit(
        valued,
        keys,
        slice_by,
        [F.sum("_value").alias("_sum")],
        lambda w: [F.coalesce(F.sum("_sum").over(before(w)), F.lit(0)).alias("_carry")],
    )
    total = F.coalesce(F.sum("_value").over(so_far(in_slice(keys, order))), F.lit(0)) + F.col("_carry")
    return carried.withColumn(name, total).drop("_value", "_carry", SLICE)


def row_number(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], name: str, start: int = 1
) -> DataFrame:
    """Position of a row in its group."""
    carried = inherit(
        df,
        keys,
        slice_by,
        [F.count(F.lit(1)).alias("_rows")],
        lambda w: [F.coalesce(F.sum("_rows").over(before(w)), F.lit(0)).alias("_carry")],
    )
    position = F.row_number().over(in_slice(keys, order)) + F.col("_carry") + F.lit(start - 1)
    return carried.withColumn(name, position.cast("bigint")).drop("_carry", SLICE)


def previous(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Adds, under new names, columns of the row before; null on the first row of a group."""
    return _neighbour(df, keys, slice_by, order, columns, back=True)


def following(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Adds, under new names, columns of the row after; null on the last row of a group."""
    return _neighbour(df, keys, slice_by, order, columns, back=False)


def _neighbour(df, keys, slice_by, order, columns, back: bool) -> DataFrame:
    packed = F.struct(*columns)
    edge = (F.max_by if back else F.min_by)(packed, F.struct(*order)).alias("_edge")
    step = F.lag if back else F.lead
    carried = inherit(df, keys, slice_by, [edge], lambda w: [step("_edge").over(w).alias("_beyond")])
    near = F.coalesce(step(packed).over(in_slice(keys, order)), F.col("_beyond"))
    kept = carried.withColumn("_near", near)
    return kept.select(*df.columns, *[F.col("_near")[old].alias(new) for old, new in columns.items()])


def range_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """``df`` range-partitioned on a unique order without any usable position, with ``_slice`` and ``_at``.

    Range bounds are sampled, so the result is written out: every later use, and every recomputation after
    a lost executor, sees the same slices. No key, however frequent, fills a slice.
    """
    spread = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    numbered = spread.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the upper bits of the id are the number of the range partition
    return written(numbered).withColumn(SLICE, F.shiftright("_at", 33))


def global_running_sum(ranged: DataFrame, value: Column, name: str) -> DataFrame:
    """Inclusive running sum over all rows of ``range_slices`` output, in its order."""
    valued = ranged.withColumn("_value", value)
    per_slice = valued.groupBy(SLICE).agg(F.sum("_value").alias("_sum"))
    # one row per range partition, so this window is small whatever the table holds
    carry = per_slice.select(
        SLICE, F.coalesce(F.sum("_sum").over(before(Window.partitionBy(F.lit(0)).orderBy(SLICE))), F.lit(0)).alias("_carry")
    )
    inside = F.sum("_value").over(so_far(Window.partitionBy(SLICE).orderBy("_at")))
    return valued.join(carry, SLICE).withColumn(name, inside + F.col("_carry")).drop("_value", "_carry")


def global_rank(df: DataFrame, order: Sequence[Column], name: str, slices: int | None = None) -> DataFrame:
    """1-based rank over the whole table in a unique order, with no single-task window."""
    ranked = global_running_sum(range_slices(df, order, slices), F.lit(1), name)
    return ranked.withColumn(name, F.col(name).cast("bigint")).drop("_at", SLICE)
