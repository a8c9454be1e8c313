"""Time-base arithmetic and per-frame measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pts_to_secs(pts: Column, num: Column, den: Column) -> Column:
    """Seconds of a timestamp in ticks of num/den; 0 when there is none."""
    return F.coalesce(pts.cast("double") * num.cast("double") / den.cast("double"), F.lit(0.0))


def origin_ticks(secs: Column, num: Column, den: Column) -> Column:
    """A time in ticks of num/den, halves away from zero."""
    return F.round(secs * den.cast("double") / num.cast("double")).cast("bigint")


def rebase_ts(ts: Column, origin: Column) -> Column:
    """The timestamp measured from the origin; null when it lies before it."""
    return F.when(ts >= origin, ts - origin)


def histogram_distance(left: Column, right: Column) -> Column:
    """Half the chi-square distance of two histograms; bins empty in both are skipped."""

    def term(a: Column, b: Column) -> Column:
        # Spark orders NaN above every number, so the bins of an empty frame are ruled out by name
        used = ~F.isnan(a + b) & (a + b > 1e-10)
        return F.when(used, (a - b) * (a - b) / (a + b)).otherwise(0.0)

    terms = F.zip_with(left, right, term)
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term) / 2.0
