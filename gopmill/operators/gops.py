"""Keyframes and groups of pictures (GOPs) from packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gopmill.functions import encode
from gopmill.operators import slices

MIN_TOLERANCE = 0.05


def is_key(flags: Column) -> Column:
    return F.coalesce(flags.contains("K"), F.lit(False))


def keyframes(packets: DataFrame, insert_zero: bool = True, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """(asset_id, kf_idx, frame_idx, ts) of the packets flagged key.

    ``insert_zero`` adds a keyframe at frame 0, time 0.0, where packet 0 is not key. With decoded frames
    (``is_key`` and ``ts`` columns in place of ``flags`` and ``pts_time``) pass ``insert_zero=False``.
    """
    flagged = is_key(F.col("flags")) if "flags" in packets.columns else F.col("is_key")
    index = F.col("packet_idx") if "packet_idx" in packets.columns else F.col("frame_idx")
    ts = F.col("pts_time") if "pts_time" in packets.columns else F.col("ts")
    wanted = flagged | (index == 0) if insert_zero else flagged
    found = packets.where(wanted).select(
        "asset_id", index.alias("frame_idx"), F.when(flagged, ts.cast("double")).otherwise(0.0).alias("ts")
    )
    numbered = slices.row_number(
        found, ["asset_id"], slices.slice_of("frame_idx", slice_rows), ["frame_idx"], "kf_idx", start=0
    )
    return numbered.select("asset_id", "kf_idx", "frame_idx", "ts")


def gop_ids(packets: DataFrame, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Packets with ``gop_idx``: a key packet opens a GOP, but packet 0 never opens a second one."""
    opens = F.when(is_key(F.col("flags")) & (F.col("packet_idx") > 0), 1).otherwise(0)
    return slices.running_sum(
        packets, ["asset_id"], slices.slice_of("packet_idx", slice_rows), ["packet_idx"], opens, "gop_idx"
    )


def gop_stats(packets: DataFrame, first_start: str = "zero", slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """One row per GOP: frames, times, bytes and bitrate.

    The first GOP starts at 0.0 whatever its first timestamp, unless ``first_start='packet'``; a GOP ends at the
    time of its last packet; its rate is 0 when it lasts 1 ms or less.
    """
    grouped = (
        gop_ids(packets, slice_rows)
        .groupBy("asset_id", "gop_idx")
        .agg(
            F.min("packet_idx").alias("start_frame"),
            F.max("packet_idx").alias("end_frame"),
            F.min_by("pts_time", "packet_idx").alias("_first"),
            F.max_by("pts_time", "packet_idx").alias("end_time"),
            F.sum("size_bytes").alias("size_bytes"),
        )
    )
    start = F.col("_first")
    if first_start == "zero":
        start = F.when(F.col("gop_idx") == 0, 0.0).otherwise(start)
    lasted = F.col("end_time") - F.col("start_time")
    rate = F.when(lasted > 0.001, F.col("size_bytes").cast("double") * 8.0 / lasted).otherwise(0.0)
    return (
        grouped.withColumn("start_time", start)
        .withColumn("bitrate_bps", rate)
        .select("asset_id", "gop_idx", "start_frame", "end_frame", "start_time", "end_time", "size_bytes", "bitrate_bps")
    )


def gop_summary(gops: DataFrame) -> DataFrame:
    """Unweighted mean, lowest and highest GOP bitrate and the number of GOPs per asset."""
    return gops.groupBy("asset_id").agg(
        F.avg("bitrate_bps").alias("avg_bitrate_bps"),
        F.min("bitrate_bps").alias("min_bitrate_bps"),
        F.max("bitrate_bps").alias("max_bitrate_bps"),
        F.count(F.lit(1)).alias("gop_count"),
    )


def media_target(media: DataFrame) -> Column:
    return encode.target_bitrate(F.col("width"), F.col("height"), F.col("crf"), F.col("encoder"))


def _check_tolerance(max_tolerance: float) -> None:
    if not max_tolerance >= MIN_TOLERANCE:
        raise ValueError(f"the tolerance bound must be at least {MIN_TOLERANCE}")


def auto_tolerance(media: DataFrame, gops: DataFrame, max_tolerance: float = 0.3) -> DataFrame:
    """(asset_id, target_bitrate, tolerance) for every asset of ``media``.

    Twice the spread of the bitrate ratios less the distance of their mean from 1, kept within
    0.05 and the bound; the bound itself where an asset has no GOPs. Mean and spread of bitrate / target are the
    bitrate's own divided by the target, so GOPs are reduced before they meet ``media``.
    """
    _check_tolerance(max_tolerance)
    spread = gops.groupBy("asset_id").agg(
        F.avg("bitrate_bps").alias("_mean"), F.stddev_pop("bitrate_bps").alias("_dev")
    )
    targets = media.select("asset_id", media_target(media).alias("target_bitrate"))
    tuned = F.least(
        F.greatest(
            2.0 * F.col("_dev") / F.col("target_bitrate") - F.abs(F.col("_mean") / F.col("target_bitrate") - 1.0),
            F.lit(MIN_TOLERANCE),
        ),
        F.lit(float(max_tolerance)),
    )
    usable = F.col("_mean").isNotNull() & (F.col("target_bitrate") > 0)
    return targets.join(spread, "asset_id", "left").select(
        "asset_id", "target_bitrate", F.when(usable, tuned).otherwise(float(max_tolerance)).alias("tolerance")
    )


def media_summary(media: DataFrame, gops: DataFrame) -> DataFrame:
    """Whole-file facts with the mean GOP bitrate (null without GOPs) and whether there is audio."""
    rates = gops.groupBy("asset_id").agg(F.avg("bitrate_bps").alias("avg_bitrate_bps"))
    has_audio = F.coalesce(F.size("audio_tracks") > 0, F.lit(False)) if "audio_tracks" in media.columns else F.lit(False)
    return media.join(rates, "asset_id", "left").select(
        "asset_id", "duration_secs", "width", "height", "fps", F.col("codec_name").alias("codec"),
        "profile", "pix_fmt", "avg_bitrate_bps", has_audio.alias("has_audio"),
    )
