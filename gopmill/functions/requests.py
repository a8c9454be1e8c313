"""Request validation and worker-result defaults as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published behaviour for right results.
FORMATS = ("hls", "mp4")
MODES = ("normal", "copy", "smart", "smart-auto")
ENCODERS = (
    "libx264", "h264_videotoolbox", "h264_nvenc", "h264_vaapi",
    "libx265", "hevc_videotoolbox", "hevc_nvenc", "hevc_vaapi",
    "libsvtav1", "libaom-av1", "av1_nvenc",
)
PRESETS = ("ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow")
SVT_PRESETS = tuple(str(n) for n in range(13))

RESULT_SCHEMA = (
    "segment_id bigint, worker_id bigint, node_id string, frames_encoded bigint, output_size_bytes bigint, "
    "encoding_time_secs double, average_complexity double, scene_changes_detected bigint"
)


def _number(value: Column) -> Column:
    """A number as a double; NaN for text, whatever it says, and for any other type."""
    plain = F.typeof(value).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return F.when(value.isNotNull(), F.when(plain, value.try_cast("double")).otherwise(F.lit(float("nan"))))


def json_number(body: Column, field: str) -> Column:
    """A field of a parsed (variant) request for the number rules: null if absent, NaN if it is no JSON number (null too)."""
    found = F.try_variant_get(body, f"$.{field}", "variant")
    number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    return F.when(found.isNull(), None).when(number, F.try_variant_get(body, f"$.{field}", "double")).otherwise(float("nan"))


def _rules(cluster: bool, max_workers: int) -> list[tuple[str, Callable[[Column], Column], str]]:
    """The rule table, in the order rules are reported: field, what a valid value fulfils, message.

    A predicate sees a value that is there (or, for body and uploadId, may be null) and never fails on its type.
    """
    listed = lambda names: lambda v: v.cast("string").isin(*names)
    within = lambda low, high: lambda v: _number(v).between(low, high) & ~F.isnan(_number(v))
    whole = lambda low, high: lambda v: within(low, high)(v) & (_number(v) == F.floor(_number(v)))
    choice = lambda field, names: (field, listed(names), f"{field} must be one of: {', '.join(names)}")
    rules = [
        ("body", lambda v: v, "request body must be an object"),
        ("uploadId", lambda v: F.length(v) > 0, "uploadId is required"),
        ("format", listed(["mp4"]), "Cluster mode produces MP4 only") if cluster else choice("format", FORMATS),
        choice("mode", MODES),
        choice("encoder", ENCODERS),
        ("preset", listed([*PRESETS, *SVT_PRESETS]), 'preset must be an x264 preset name or "0"-"12"'),
        ("crf", whole(0, 63), "crf must be an integer between 0 and 63"),
        ("workers", whole(0, max_workers), f"workers must be an integer between 0 and {max_workers}"),
        ("smartTolerance", within(0.05, 1.0), "smartTolerance must be a number between 0.05 and 1.0"),
        ("verbose", lambda v: v, "verbose must be a boolean"),
    ]
    return [rule for rule in rules if not (cluster and rule[0] == "workers")]


REQUIRED = ("body", "uploadId")


def validate_request(columns: dict[str, Column], cluster: bool = False, max_workers: int = 64) -> Column:
    """struct(field, error) of the first rule a request breaks, or null when it is fine.

    ``columns`` maps request fields (``body``, ``uploadId``, ``format``, ``mode``, ``encoder``, ``preset``, ``crf``,
    ``workers``, ``smartTolerance``, ``verbose``) to columns; a field left out is absent from every request.
    A null value is an absent field. ``crf``, ``workers`` and ``smartTolerance`` are numbers only if their columns are:
    text is refused, whatever it says. ``body`` and ``verbose`` are booleans: is the body an object, and is the value
    itself a boolean (its type is settled when the request is parsed).
    """
    broken = []
    for field, fulfils, message in _rules(cluster, max_workers):
        value = columns.get(field)
        if value is None and field != "uploadId":
            continue
        if field in REQUIRED:
            wrong = F.lit(True) if value is None else ~F.coalesce(fulfils(value), F.lit(False))
        else:
            wrong = value.isNotNull() & ~F.coalesce(fulfils(value), F.lit(False))
        broken.append(F.when(wrong, F.struct(F.lit(field).alias("field"), F.lit(message).alias("error"))))
    return F.coalesce(*broken)


def result_or_default(
    raw: Column,
    segment_id: Column,
    node_id: Column,
    start_frame: Column,
    end_frame: Column,
    size_bytes: Column,
    elapsed_secs: Column,
    complexity: Column,
    scene_changes: Column,
) -> Column:
    """The worker's own result when its text holds every field, else one built from the segment."""
    fields = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]

    def whole(result: Column) -> Column:
        held = result.isNotNull()
        for name in fields:
            held = held & result[name].isNotNull()
        return held

    # through an array of one, so that the text is parsed once and not once per field
    parsed = F.get(F.filter(F.array(F.from_json(raw, RESULT_SCHEMA)), whole), F.lit(0))
    built = F.struct(
        segment_id.cast("bigint").alias("segment_id"),
        F.lit(0).cast("bigint").alias("worker_id"),
        node_id.cast("string").alias("node_id"),
        (F.greatest(end_frame - start_frame, F.lit(0)) + 1).cast("bigint").alias("frames_encoded"),
        F.coalesce(size_bytes, F.lit(0)).cast("bigint").alias("output_size_bytes"),
        elapsed_secs.cast("double").alias("encoding_time_secs"),
        complexity.cast("double").alias("average_complexity"),
        scene_changes.cast("bigint").alias("scene_changes_detected"),
    )
    return F.coalesce(parsed, built)
