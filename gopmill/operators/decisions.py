"""Copy-or-encode planning and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gopmill.functions import encode
from gopmill.operators import gops as gop_ops
from gopmill.operators.rangejoin import ROWS_PER_TASK, overlap_join, spread_hot

# They must equal the published behaviour for right results.
COPY_FRACTION = 0.9
NORMAL_FRACTION = 0.1
SMART_MODES = ("smart", "smart-auto")
BLOCKERS_TYPE = "array<struct<kind:string,source:string,target:string>>"


def media_blockers() -> Column:
    return encode.copy_blockers(F.col("codec_name"), F.col("profile"), F.col("pix_fmt"), F.col("encoder"))


def gops_in_ranges(
    ranges: DataFrame, gops: DataFrame, width: float = 10.0, rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Pairs of range and GOP of one asset that overlap, strictly at both ends.

    Width is about the length of a range, so a range or GOP touches a few buckets.
    """
    slim_gops = gops.select("asset_id", "gop_idx", "start_time", "end_time", "bitrate_bps")
    slim_ranges = ranges.select("asset_id", "segment_id", "start_ts", "end_ts")
    overlap = (F.col("start_time") < F.col("end_ts")) & (F.col("end_time") > F.col("start_ts"))
    return overlap_join(
        slim_gops, slim_ranges, ["asset_id"], ("start_time", "end_time"), ("start_ts", "end_ts"), width, overlap, rows_per_task
    )


def plan_segments(
    media: DataFrame,
    ranges: DataFrame,
    gops: DataFrame,
    mode: str = "normal",
    tolerance: float = 0.3,
    width: float = 10.0,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Per range: copy or encode, bitrate ratio, blockers, tolerance and target bitrate.

    ``copy`` and ``normal`` (and any unknown mode) never touch the GOPs. ``ranges`` and ``gops`` are read more than
    once, so pass stored tables.
    """
    base = media.select(
        "asset_id",
        gop_ops.media_target(media).alias("target_bitrate"),
        media_blockers().alias("blockers"),
    )
    spans = ranges.select("asset_id", "segment_id", "start_ts", "end_ts")
    if mode not in SMART_MODES:
        dealt, repeated, on = spread_hot(spans, base, ["asset_id"], rows_per_task)
        return dealt.join(repeated, on).select(
            "asset_id", "segment_id", "start_ts", "end_ts",
            F.lit(mode == "copy").alias("copy"),
            F.lit(None).cast("double").alias("bitrate_ratio"),
            F.array().cast(BLOCKERS_TYPE).alias("blockers"),
            F.lit(float(tolerance)).alias("tolerance"),
            "target_bitrate",
        )
    if mode == "smart-auto":
        tuned = gop_ops.auto_tolerance(media, gops, tolerance).select("asset_id", "tolerance")
        base = base.join(tuned, "asset_id")
    else:
        base = base.withColumn("tolerance", F.lit(float(tolerance)))
    rates = (
        gops_in_ranges(spans, gops, width, rows_per_task)
        .groupBy("asset_id", "segment_id")
        .agg(F.avg("bitrate_bps").alias("_rate"))
    )
    ratio = F.col("_rate") / F.col("target_bitrate")
    near = (ratio >= 1.0 - F.col("tolerance")) & (ratio <= 1.0 + F.col("tolerance"))
    copy = F.when(F.size("blockers") > 0, F.lit(False)).otherwise(F.coalesce(near, F.lit(False)))
    dealt, repeated, on = spread_hot(spans, base, ["asset_id"], rows_per_task)
    return (
        dealt.join(rates, ["asset_id", "segment_id"], "left")
        .join(repeated, on)
        .select(
            "asset_id", "segment_id", "start_ts", "end_ts", copy.alias("copy"), ratio.alias("bitrate_ratio"),
            "blockers", "tolerance", "target_bitrate",
        )
    )


def _percent(share: Column) -> Column:
    return F.round(share * 100.0).cast("bigint").cast("string")


def recommend(
    media: DataFrame, gops: DataFrame, max_tolerance: float = 0.3, rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """(asset_id, mode, preset, reasons, copyable_gop_fraction) per asset. ``gops`` is read more than once: store it."""
    tuned = gop_ops.auto_tolerance(media, gops, max_tolerance)
    near = F.abs(F.col("bitrate_bps") / F.col("target_bitrate") - 1.0) <= F.col("tolerance")
    dealt, repeated, on = spread_hot(gops.select("asset_id", "gop_idx", "bitrate_bps"), tuned, ["asset_id"], rows_per_task)
    shares = dealt.join(repeated, on).groupBy("asset_id").agg(F.avg(near.cast("double")).alias("_share"))
    work = encode.work_units(F.col("width"), F.col("height"), F.col("fps"), F.col("duration_secs"))
    facts = (
        media.withColumn("_blockers", media_blockers())
        .withColumn("_work", work)
        .join(tuned.select("asset_id", "tolerance"), "asset_id")
        .join(shares, "asset_id", "left")
        .withColumn("preset", encode.preset_for_work(F.col("_work")))
    )
    share, blocked = F.col("_share"), F.size("_blockers") > 0
    mode = (
        F.when(blocked | share.isNull(), "normal")
        .when(share >= COPY_FRACTION, "copy")
        .when(share <= NORMAL_FRACTION, "normal")
        .otherwise("smart-auto")
    )
    listed = F.array_join(F.transform("_blockers", encode.describe_blocker), "; ")
    pct = _percent(share)
    reason = (
        F.when(blocked, F.concat(F.lit("re-encode everything: "), listed))
        .when(share.isNull(), F.lit("no GOP bitrate data; re-encode everything"))
        .when(
            share >= COPY_FRACTION,
            F.concat(
                pct, F.lit("% of GOPs within ±"), _percent(F.col("tolerance")),
                F.lit("% of the target bitrate; stream-copy"),
            ),
        )
        .when(
            share <= NORMAL_FRACTION,
            F.concat(F.lit("only "), pct, F.lit("% of GOPs near the target bitrate; re-encode everything")),
        )
        .otherwise(F.concat(pct, F.lit("% of GOPs near the target bitrate; copy those, re-encode the rest")))
    )
    minutes = F.round(F.col("_work") / 60.0).cast("bigint").cast("string")
    preset_reason = F.concat(
        F.lit("preset "), F.col("preset"), F.lit(": about "), minutes, F.lit(" min of 1080p30-equivalent work")
    )
    return facts.select(
        "asset_id", mode.alias("mode"), "preset", F.array(reason, preset_reason).alias("reasons"),
        F.when(~blocked, share).alias("copyable_gop_fraction"),
    )


def segment_reasons(plan: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """The plan with ``decision`` and ``reasons``: blockers first, then the bitrate or the lack of GOPs."""
    ratio = F.col("bitrate_ratio")
    outside = ~F.col("copy") & ((ratio < 1.0 - tolerance) | (ratio > 1.0 + tolerance))
    text = F.concat(
        F.lit("bitrate ratio "), F.format_string("%.2f", ratio), F.lit(f" outside ±{round(tolerance * 100)}%")
    )
    own = F.when(ratio.isNull(), F.lit("no GOP data")).when(outside, text)
    reasons = F.array_compact(F.concat(F.transform("blockers", encode.describe_blocker), F.array(own)))
    return plan.select(
        "asset_id", "segment_id", "start_ts", "end_ts",
        F.when(F.col("copy"), "copy").otherwise("encode").alias("decision"), "bitrate_ratio", reasons.alias("reasons"),
    )


def report_summary(plan: DataFrame) -> DataFrame:
    """Segment counts by decision and the blocker texts per asset."""
    return (
        # the blockers belong to the asset, so they only ride along as a key
        plan.groupBy("asset_id", "blockers")
        .agg(
            F.count(F.lit(1)).alias("total_segments"),
            F.count_if("copy").alias("copy_segments"),
            F.count_if(~F.col("copy")).alias("encode_segments"),
        )
        .withColumn("global_blockers", F.transform("blockers", encode.describe_blocker))
        .drop("blockers")
    )
