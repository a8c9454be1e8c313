"""Copy-or-encode rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published behaviour for right results.
CODEC_OF_ENCODER = {
    "libx264": "h264",
    "h264_videotoolbox": "h264",
    "videotoolbox": "h264",
    "h264_nvenc": "h264",
    "h264_vaapi": "h264",
    "libx265": "hevc",
    "hevc_videotoolbox": "hevc",
    "hevc_nvenc": "hevc",
    "hevc_vaapi": "hevc",
    "libvpx-vp9": "vp9",
    "libaom-av1": "av1",
    "libsvtav1": "av1",
    "av1_nvenc": "av1",
}
UHD_PIXELS, FULL_HD_PIXELS, HD_PIXELS = 3840 * 2160, 1920 * 1080, 1280 * 720
TARGET_TIERS = (40_000_000.0, 8_000_000.0, 4_000_000.0, 2_000_000.0)
CRF_STEP, CRF_BASE = 1.12, 23
VIDEOTOOLBOX_TIERS = (50_000_000, 20_000_000, 10_000_000, 5_000_000)
VIDEOTOOLBOX_HEVC_TIERS = (30_000_000, 10_000_000, 5_000_000, 2_500_000)
GPU_TIERS = (40_000_000, 15_000_000, 8_000_000, 4_000_000)
SVT_PRESETS = {
    "ultrafast": "12", "superfast": "10", "veryfast": "8", "faster": "7", "fast": "6",
    "medium": "5", "slow": "4", "slower": "2", "veryslow": "0",
}
AOM_CPU_USED = {
    "ultrafast": "8", "superfast": "7", "veryfast": "6", "faster": "5", "fast": "4",
    "medium": "3", "slow": "2", "slower": "1", "veryslow": "0",
}
PROFILE_RANKS = {
    "baseline": 1, "constrained baseline": 1,
    "main": 2,
    "high": 3, "high 10": 3, "high 4:2:2": 3, "high 4:4:4": 3, "high 4:4:4 predictive": 3,
}
TEXT_SUBTITLES = ("srt", "ass", "ssa", "webvtt", "subrip", "mov_text", "text")
TEN_BIT_FORMATS = ("yuv420p10le", "yuv420p10be", "p010le", "p010be")


def _lookup(key: Column, table: dict) -> Column:
    """``when`` chain over a fixed table; null where the key is not in it."""
    return reduce(lambda chain, kv: chain.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), None))


def _tier(pixels: Column, values) -> Column:
    return (
        F.when(pixels >= UHD_PIXELS, values[0])
        .when(pixels >= FULL_HD_PIXELS, values[1])
        .when(pixels >= HD_PIXELS, values[2])
        .otherwise(values[3])
    )


def _pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def encoder_to_codec(encoder: Column) -> Column:
    return F.coalesce(_lookup(encoder, CODEC_OF_ENCODER), encoder)


def target_bitrate(width: Column, height: Column, crf: Column, encoder: Column) -> Column:
    """Expected bits per second: resolution tier, 12 % per CRF step, encoder efficiency."""
    vt, nvenc, vaapi = (encoder.contains(part) for part in ("videotoolbox", "nvenc", "vaapi"))
    hevc, av1 = encoder.contains("hevc"), encoder.contains("av1")
    efficiency = (
        F.when(vt, F.when(hevc, 1.0).otherwise(2.0))
        .when(nvenc, F.when(hevc | av1, 0.7).otherwise(1.5))
        .when(vaapi, F.when(hevc, 0.8).otherwise(1.5))
        .when(encoder == "libx265", 0.5)
        .when(encoder == "libsvtav1", 0.4)
        .when(encoder == "libaom-av1", 0.35)
        .otherwise(1.0)
    )
    quality = F.pow(F.lit(CRF_STEP), (F.lit(CRF_BASE) - crf.cast("int")).cast("double"))
    return _tier(_pixels(width, height), TARGET_TIERS) * quality * efficiency


def hw_default_bitrate(width: Column, height: Column, encoder: Column, kbps: Column | None = None) -> Column:
    """Default rate of a hardware encoder in bits per second; null for software encoders.

    A given rate in kbit/s above 0 wins.
    """
    pixels = _pixels(width, height)
    hevc = encoder.contains("x265") | encoder.contains("hevc")
    av1 = encoder.contains("svtav1") | encoder.contains("aom-av1") | (encoder == "av1_nvenc")
    base = _tier(pixels, GPU_TIERS).cast("bigint")
    two_thirds = F.floor(base * 2 / 3).cast("bigint")
    default = (
        F.when(
            encoder.contains("videotoolbox"),
            F.when(hevc, _tier(pixels, VIDEOTOOLBOX_HEVC_TIERS)).otherwise(_tier(pixels, VIDEOTOOLBOX_TIERS)),
        )
        .when(encoder.contains("nvenc"), F.when(hevc | av1, two_thirds).otherwise(base))
        .when(encoder.contains("vaapi"), F.when(hevc, two_thirds).otherwise(base))
        .cast("bigint")
    )
    if kbps is None:
        return default
    return F.when(default.isNotNull() & (kbps > 0), kbps.cast("bigint") * 1000).otherwise(default)


def native_preset(encoder: Column, preset: Column) -> Column:
    """The encoder's own preset value; names it does not know pass through."""
    return F.coalesce(
        F.when(encoder == "libsvtav1", _lookup(preset, SVT_PRESETS)).when(
            encoder == "libaom-av1", _lookup(preset, AOM_CPU_USED)
        ),
        preset,
    )


def work_units(width: Column, height: Column, fps: Column, duration: Column) -> Column:
    """Encode work in seconds of 1080p at 30 fps; 0 when not a positive finite number."""
    work = width.cast("double") * height.cast("double") * fps * duration / F.lit(1920.0 * 1080.0 * 30.0)
    usable = work.isNotNull() & ~F.isnan(work) & (work > 0) & (work < float("inf"))
    return F.when(usable, work).otherwise(0.0)


def preset_for_work(work: Column) -> Column:
    return F.when(work <= 120.0, "slow").when(work <= 900.0, "medium").when(work <= 3600.0, "fast").otherwise("veryfast")


def profile_rank(profile: Column) -> Column:
    return F.coalesce(_lookup(F.lower(profile), PROFILE_RANKS), F.lit(2))


def profile_compatible(source: Column, target: Column) -> Column:
    return profile_rank(source) <= profile_rank(target)


def target_profile(encoder: Column) -> Column:
    return F.when(encoder.isin("h264_videotoolbox", "videotoolbox"), "Main").otherwise("High")


def target_pix_fmt(encoder: Column) -> Column:
    return F.lit("yuv420p")


def _blocker(kind: str, source: Column, target: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"))


def copy_blockers(codec: Column, profile: Column, pix_fmt: Column, encoder: Column) -> Column:
    """Array of struct(kind, source, target): why a source cannot be stream-copied."""
    wanted = encoder_to_codec(encoder)
    profile_above = (wanted == "h264") & profile.isNotNull() & ~profile_compatible(profile, target_profile(encoder))
    return F.array_compact(
        F.array(
            F.when(wanted != codec, _blocker("codec", codec, wanted)),
            F.when(profile_above, _blocker("profile", profile, target_profile(encoder))),
            F.when(
                pix_fmt.isNotNull() & (pix_fmt != target_pix_fmt(encoder)),
                _blocker("pix_fmt", pix_fmt, target_pix_fmt(encoder)),
            ),
        )
    )


def describe_blocker(blocker: Column) -> Column:
    source, target = blocker["source"], blocker["target"]
    return (
        F.when(blocker["kind"] == "codec", F.concat(F.lit("source codec "), source, F.lit(" differs from target "), target))
        .when(blocker["kind"] == "profile", F.concat(F.lit("source profile "), source, F.lit(" is above target "), target))
        .otherwise(F.concat(F.lit("source pixel format "), source, F.lit(" differs from target "), target))
    )


def output_pix_fmt(encoder: Column, source: Column) -> Column:
    """10-bit output only for HEVC and AV1 with a 10-bit source."""
    deep = (
        encoder.contains("x265") | encoder.contains("hevc") | encoder.contains("svtav1")
        | encoder.contains("aom-av1") | (encoder == "av1_nvenc")
    )
    return F.when(deep & F.coalesce(source, F.lit("")).isin(*TEN_BIT_FORMATS), "yuv420p10le").otherwise("yuv420p")


def is_text_subtitle(codec: Column) -> Column:
    return codec.isin(*TEXT_SUBTITLES)


def effective_mode(smart_auto: Column, smart: Column, smart_report: Column, copy: Column, fast: Column) -> Column:
    """struct(mode, fast): the mode the flags ask for; any of them implies the fast path."""
    return F.struct(
        F.when(smart_auto, "smart-auto")
        .when(smart | smart_report, "smart")
        .when(copy, "copy")
        .otherwise("normal")
        .alias("mode"),
        (fast | copy | smart | smart_auto | smart_report).alias("fast"),
    )
