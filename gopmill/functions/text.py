"""Small parsing and naming helpers, all JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_double(text: Column) -> Column:
    """A double, or null where the text is padded, suffixed or not a number."""
    looks_numeric = text.rlike(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")
    return F.when(looks_numeric, text.try_cast("double"))


def strict_unsigned(text: Column) -> Column:
    """A non-negative bigint, or null."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))


def parse_rational(text: Column) -> Column:
    """``n/d`` as a double. A bad n counts as 30, a bad d as 1; 30 when d is 0 or nothing parses."""
    num = F.coalesce(strict_double(F.regexp_extract(text, r"^([^/]*)/", 1)), F.lit(30.0))
    den = F.coalesce(strict_double(F.regexp_extract(text, r"^[^/]*/(.*)$", 1)), F.lit(1.0))
    ratio = F.when(den != 0.0, num / F.when(den != 0.0, den)).otherwise(30.0)
    return F.when(text.contains("/"), ratio).otherwise(F.coalesce(strict_double(text), F.lit(30.0)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _extension(name: Column) -> Column:
    """The last ``.xyz`` of a file name, '' for none and for a name that only starts with a dot."""
    return F.regexp_extract(name, r"^.+(\.[^./]*)$", 1)


def safe_upload_name(name: Column, millis: Column) -> Column:
    """Stored name of an upload: cleaned base name, arrival time, extension."""
    last = base_name(name)
    ext = _extension(last)
    stem = F.substring(last, F.lit(1), F.length(last) - F.length(ext))
    return F.concat(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), F.lit("_"), millis.cast("string"), ext)


def safe_url_name(url: Column, millis: Column) -> Column:
    """Stored name of a file fetched by URL; ``video`` and ``.mp4`` where the URL names nothing."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    last = base_name(path)
    named = F.when(last == "", F.lit("video")).otherwise(last)
    safe = F.substring(F.regexp_replace(named, "[^a-zA-Z0-9._-]", "_"), 1, 200)
    ext = _extension(safe)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ext))
    return F.concat(stem, F.lit("_"), millis.cast("string"), F.when(ext == "", ".mp4").otherwise(ext))


def source_file_name(uri: Column) -> Column:
    """``source`` plus the extension of the object the URI names."""
    return F.concat(F.lit("source"), _extension(base_name(uri)))


def is_object_uri(uri: Column) -> Column:
    return uri.startswith("s3://")


def parse_object_uri(uri: Column) -> Column:
    """struct(bucket, key) of ``s3://bucket/key``; null when malformed."""
    pattern = r"(?s)^s3://([^/]+)/(.+)$"
    return F.when(
        uri.rlike(pattern),
        F.struct(F.regexp_extract(uri, pattern, 1).alias("bucket"), F.regexp_extract(uri, pattern, 2).alias("key")),
    )


def url_scheme_allowed(url: Column) -> Column:
    """The URL parses, names a host and its scheme is http or https."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & host.isNotNull(), F.lit(False))


def input_key(job: Column, segment: Column) -> Column:
    return F.concat(F.lit("jobs/"), job.cast("string"), F.lit("/input/seg_"), segment.cast("string"), F.lit(".ts"))


def output_key(job: Column, segment: Column) -> Column:
    return F.concat(F.lit("jobs/"), job.cast("string"), F.lit("/output/seg_"), segment.cast("string"), F.lit(".ts"))


def final_key(job: Column) -> Column:
    return F.concat(F.lit("jobs/"), job.cast("string"), F.lit("/final/output.mp4"))


def source_key(name: Column) -> Column:
    return F.concat(F.lit("sources/"), base_name(name))


def segment_file_name(segment: Column) -> Column:
    return F.format_string("segment_%04d.ts", segment.cast("bigint"))


def subtitle_file_name(language: Column) -> Column:
    return F.concat(F.lit("subs_"), F.coalesce(language, F.lit("und")), F.lit(".vtt"))
