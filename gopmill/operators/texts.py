"""Output texts: playlists, concat lists, chapter metadata, JSON reports.

A text that lists segments is a table of its lines, (asset_id, line_no, line), whatever its length: a text is its lines in
the order of line_no, each followed by a line feed. ``write_lines`` writes them in that order, range-partitioned, so no
asset, however long, has its lines gathered into one value or one task; ``write_asset_files`` writes a file per asset. A report is one JSON row for the asset and one
for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gopmill.functions import encode, text
from gopmill.operators import jobs
from gopmill.operators.segments import max_segment_duration
from gopmill.sources.files import write_files

HEAD_LINES = 4


def hls_playlist(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Media playlist of each asset with results: the results in segment order with their segments' durations.

    The target duration is taken over all segments; a result without a segment lasts 0.
    ``results(asset_id, segment_id, output_path)``. Line numbers grow with the segment and leave gaps.
    """
    timed = jobs.results_with_segments(results.select("asset_id", "segment_id", "output_path"), segments)
    at = F.lit(HEAD_LINES) + 2 * F.col("segment_id")
    pairs = F.array(
        F.struct(at.cast("bigint").alias("line_no"), F.concat(F.lit("#EXTINF:"), F.format_string("%.6f", "duration"), F.lit(",")).alias("line")),
        F.struct((at + 1).cast("bigint").alias("line_no"), text.base_name(F.col("output_path")).alias("line")),
    )
    body = timed.select("asset_id", F.inline(pairs))
    ends = results.groupBy("asset_id").agg(F.max("segment_id").alias("_last")).join(max_segment_duration(segments), "asset_id", "left")
    target = F.concat(F.lit("#EXT-X-TARGETDURATION:"), F.coalesce("target_duration", F.lit(0)).cast("string"))
    head = [F.lit("#EXTM3U"), F.lit("#EXT-X-VERSION:3"), target, F.lit("#EXT-X-MEDIA-SEQUENCE:0")]
    frame = [F.struct(F.lit(n).cast("bigint").alias("line_no"), line.alias("line")) for n, line in enumerate(head)]
    frame.append(F.struct((F.lit(HEAD_LINES + 2) + 2 * F.col("_last")).cast("bigint").alias("line_no"), F.lit("#EXT-X-ENDLIST").alias("line")))
    return body.unionByName(ends.select("asset_id", F.inline(F.array(*frame))))


def concat_list(results: DataFrame) -> DataFrame:
    """Concat list of the results' base names in segment order: (asset_id, line_no, line)."""
    line = F.concat(F.lit("file '"), text.base_name(F.col("output_path")), F.lit("'"))
    return results.select("asset_id", F.col("segment_id").cast("bigint").alias("line_no"), line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose lines, in the order of the files, are the texts of the assets one after another."""
    lines.repartitionByRange("asset_id", "line_no").sortWithinPartitions("asset_id", "line_no").select("line").write.text(path)


def write_asset_files(lines: DataFrame, folder: str, suffix: str, part_lines: int = 1_000_000) -> None:
    """One file ``<asset_id><suffix>`` for each asset's text, committed as a whole job.

    A text whose line numbers reach ``part_lines`` goes on in ``<asset_id><suffix>.part1`` and so on, which are other tasks'
    work: the text is its parts one after another.
    """
    part = F.call_function("div", F.col("line_no"), F.lit(part_lines))
    name = F.concat(
        F.regexp_replace(F.col("asset_id").cast("string"), "[^a-zA-Z0-9._-]", "_"), F.lit(suffix),
        F.when(part > 0, F.concat(F.lit(".part"), part.cast("string"))).otherwise(""),
    )
    chunk = F.concat(F.col("line"), F.lit("\n")).cast("binary")
    placed = lines.select(name.alias("name"), "line_no", chunk.alias("chunk"))
    write_files(placed.repartition("name").sortWithinPartitions("name", "line_no"), folder)


def _lines_of(array: Column, line) -> Column:
    return F.array_join(F.transform(array, line), "")


def subtitle_files(tracks: Column) -> Column:
    """Array of struct(language, file) of the text subtitle tracks; of two tracks in one language the last stays."""
    texts = F.filter(tracks, lambda t: encode.is_text_subtitle(t["codec_name"]))
    named = F.transform(
        texts,
        lambda t: F.struct(
            F.coalesce(t["language"], F.lit("und")).alias("language"),
            text.subtitle_file_name(t["language"]).alias("file"),
        ),
    )
    indexed = F.transform(named, lambda t, i: F.struct(t.alias("track"), i.alias("pos")))
    last = F.filter(
        indexed,
        lambda e: ~F.exists(indexed, lambda o: (o["pos"] > e["pos"]) & (o["track"]["file"] == e["track"]["file"])),
    )
    return F.transform(last, lambda e: e["track"])


def hls_master(media: DataFrame) -> DataFrame:
    """(asset_id, text) master playlist of every asset with audio or text subtitle tracks."""
    audio = F.col("audio_tracks")
    with_subs = media.withColumn("_subs", subtitle_files(F.col("subtitle_tracks")))
    audio_lines = _lines_of(
        audio,
        lambda t: F.concat(
            F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",LANGUAGE="'), F.coalesce(t["language"], F.lit("und")),
            F.lit('",NAME="'), F.coalesce(t["language"], F.lit("Default")), F.lit('",DEFAULT='),
            F.when(t["is_default"], "YES").otherwise("NO"), F.lit(",AUTOSELECT=YES\n"),
        ),
    )
    sub_lines = _lines_of(
        F.col("_subs"),
        lambda t: F.concat(
            F.lit('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",LANGUAGE="'), t["language"], F.lit('",NAME="'), t["language"],
            F.lit('",DEFAULT=NO,AUTOSELECT=YES,URI="'), t["file"], F.lit('"\n'),
        ),
    )
    has_audio = F.coalesce(F.size(audio) > 0, F.lit(False))
    has_subs = F.coalesce(F.size("_subs") > 0, F.lit(False))
    whole = F.concat(
        F.lit("#EXTM3U\n"), F.coalesce(audio_lines, F.lit("")), F.coalesce(sub_lines, F.lit("")),
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH=0"),
        F.when(has_audio, ',AUDIO="audio"').otherwise(""), F.when(has_subs, ',SUBTITLES="subs"').otherwise(""),
        F.lit("\nvideo.m3u8\n"),
    )
    return with_subs.where(has_audio | has_subs).select("asset_id", whole.alias("text"))


def chapter_metadata(media: DataFrame) -> DataFrame:
    """(asset_id, text) chapter metadata, times in truncated milliseconds, of every asset with chapters."""

    def millis(secs: Column) -> Column:
        return (secs * 1000.0).cast("bigint").cast("string")

    lines = _lines_of(
        F.col("chapters"),
        lambda c: F.concat(
            F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), millis(c["start_secs"]), F.lit("\nEND="), millis(c["end_secs"]),
            F.lit("\n"), F.coalesce(F.concat(F.lit("title="), c["title"], F.lit("\n")), F.lit("")),
        ),
    )
    return media.where(F.size("chapters") > 0).select("asset_id", F.concat(F.lit(";FFMETADATA1\n"), lines).alias("text"))


def smart_report(reasons: DataFrame, summary: DataFrame, media: DataFrame, recommendation: DataFrame) -> DataFrame:
    """(asset_id, segment_id, text): JSON of each segment, and of each asset (null segment) its summary, media and advice.

    Takes the outputs of segment_reasons, report_summary, media_summary (with an ``input`` column where the
    source's name is known) and recommend. Absent values are written as null.
    """
    keep_null = {"ignoreNullFields": "false"}
    entry = F.struct(
        F.col("segment_id").alias("id"), F.col("start_ts").alias("start_time"), F.col("end_ts").alias("end_time"), "decision", "bitrate_ratio", "reasons"
    )
    segments = reasons.select("asset_id", F.col("segment_id").cast("bigint").alias("segment_id"), F.to_json(entry, keep_null).alias("text"))
    name = F.col("input") if "input" in media.columns else F.col("asset_id").cast("string")
    facts = F.struct("duration_secs", "width", "height", "fps", "codec", "profile", "pix_fmt", "avg_bitrate_bps", "has_audio")
    counts = F.struct("total_segments", "copy_segments", "encode_segments", "global_blockers")
    advice = F.struct("mode", "preset", "reasons", "copyable_gop_fraction")
    heads = (
        media.select("asset_id", name.alias("input"), facts.alias("media"))
        .join(summary.select("asset_id", counts.alias("summary")), "asset_id")
        .join(recommendation.select("asset_id", advice.alias("recommendation")), "asset_id")
    )
    whole = F.to_json(F.struct("input", "summary", "media", "recommendation"), keep_null)
    return segments.unionByName(heads.select("asset_id", F.lit(None).cast("bigint").alias("segment_id"), whole.alias("text")))


def object_keys(segments: DataFrame) -> DataFrame:
    """Segments (job_id, segment_id) with their object keys and local file name."""
    job, segment = F.col("job_id"), F.col("segment_id")
    return segments.select(
        "job_id", "segment_id",
        text.input_key(job, segment).alias("input_key"),
        text.output_key(job, segment).alias("output_key"),
        text.final_key(job).alias("final_key"),
        text.segment_file_name(segment).alias("file_name"),
    )
