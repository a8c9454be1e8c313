"""Probe documents (streams, format, chapters; packets) to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gopmill.functions.encode import is_text_subtitle
from gopmill.functions.text import parse_rational, strict_double, strict_unsigned
from gopmill.operators import slices
from gopmill.session import written

# Every scalar is read as text and parsed strictly, whether the document quotes it or not.
PROBE_SCHEMA = """
    streams array<struct<
        index: string, codec_type: string, codec_name: string, width: string, height: string, profile: string,
        pix_fmt: string, r_frame_rate: string, duration: string, nb_frames: string, channels: string,
        channel_layout: string, sample_rate: string, bit_rate: string,
        tags: struct<language: string>, disposition: struct<default: string>>>,
    format struct<duration: string>,
    chapters array<struct<id: string, time_base: string, start: string, end: string, tags: struct<title: string>>>
"""
PACKET_SCHEMA = "pts_time string, size string, flags string"
PACKETS_SCHEMA = "packets array<struct<pts_time: string, size: string, flags: string>>"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(asset_path, json): one row per document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("asset_path"), F.col("value").alias("json")
    )


def _number(value: Column, default: int = 0) -> Column:
    return F.coalesce(strict_unsigned(value), F.lit(default).cast("bigint"))


def _of_kind(streams: Column, kind: str) -> Column:
    return F.filter(streams, lambda s: s["codec_type"] == kind)


def _audio(s: Column) -> Column:
    return F.struct(
        _number(s["index"]).alias("stream_index"),
        F.coalesce(s["codec_name"], F.lit("unknown")).alias("codec_name"),
        s["tags"]["language"].alias("language"),
        _number(s["channels"]).cast("int").alias("channels"),
        s["channel_layout"].alias("channel_layout"),
        _number(s["sample_rate"]).cast("int").alias("sample_rate"),
        strict_unsigned(s["bit_rate"]).alias("bitrate_bps"),
        F.coalesce(s["disposition"]["default"] == "1", F.lit(False)).alias("is_default"),
    )


def _subtitle(s: Column) -> Column:
    codec = F.coalesce(s["codec_name"], F.lit("unknown"))
    return F.struct(
        _number(s["index"]).alias("stream_index"),
        codec.alias("codec_name"),
        s["tags"]["language"].alias("language"),
        is_text_subtitle(codec).alias("is_text_based"),
        F.coalesce(s["disposition"]["default"] == "1", F.lit(False)).alias("is_default"),
    )


def _chapter(c: Column) -> Column:
    base = parse_rational(F.coalesce(c["time_base"], F.lit("1/1000000000")))
    ticks = [F.coalesce(c[name].try_cast("bigint"), F.lit(0)).cast("double") * base for name in ("start", "end")]
    return F.struct(
        _number(c["id"]).alias("id"), ticks[0].alias("start_secs"), ticks[1].alias("end_secs"), c["tags"]["title"].alias("title")
    )


def parse_probe(documents: DataFrame, text: str = "json") -> DataFrame:
    """Media rows from probe documents; the other columns of ``documents`` stay.

    The first video stream describes the asset. A document without one, or whose size is missing, gives no row:
    see ``probe_rejects``.
    """
    kept = [c for c in documents.columns if c != text]
    parsed = documents.select(*kept, F.from_json(F.col(text), PROBE_SCHEMA).alias("_p"))
    streams = F.col("_p.streams")
    video = F.get(_of_kind(streams, "video"), F.lit(0))
    facts = parsed.select(
        *kept,
        video.alias("_v"),
        F.col("_p.format.duration").alias("_format_duration"),
        F.coalesce(F.transform(_of_kind(streams, "audio"), _audio), F.array()).alias("audio_tracks"),
        F.coalesce(F.transform(_of_kind(streams, "subtitle"), _subtitle), F.array()).alias("subtitle_tracks"),
        F.coalesce(F.transform(F.col("_p.chapters"), _chapter), F.array()).alias("chapters"),
    )
    fps = parse_rational(F.coalesce(F.col("_v.r_frame_rate"), F.lit("30/1")))
    duration = F.coalesce(strict_double(F.col("_v.duration")), strict_double(F.col("_format_duration")), F.lit(0.0))
    return (
        facts.withColumn("width", strict_unsigned(F.col("_v.width")).cast("int"))
        .withColumn("height", strict_unsigned(F.col("_v.height")).cast("int"))
        .where(F.col("width").isNotNull() & F.col("height").isNotNull())
        .withColumn("fps", fps)
        .withColumn("duration_secs", duration)
        .select(
            *kept, "duration_secs", "width", "height", "fps",
            F.coalesce(
                strict_unsigned(F.col("_v.nb_frames")), F.round(F.col("duration_secs") * F.col("fps")).cast("bigint")
            ).alias("total_frames"),
            F.coalesce("_v.codec_name", F.lit("unknown")).alias("codec_name"),
            F.col("_v.profile").alias("profile"), F.col("_v.pix_fmt").alias("pix_fmt"),
            "audio_tracks", "subtitle_tracks", "chapters",
        )
    )


def probe_rejects(documents: DataFrame, text: str = "json") -> DataFrame:
    """Documents without a usable video stream, with the reason."""
    parsed = F.from_json(F.col(text), PROBE_SCHEMA)
    video = F.get(_of_kind(parsed["streams"], "video"), F.lit(0))
    reason = (
        F.when(parsed["streams"].isNull(), "No streams found")
        .when(video.isNull(), "No video stream found")
        .when(strict_unsigned(video["width"]).isNull(), "Missing width")
        .when(strict_unsigned(video["height"]).isNull(), "Missing height")
    )
    return documents.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_probe_json(spark: SparkSession, path: str) -> DataFrame:
    """Media table of a folder of probe documents, one file per asset."""
    return parse_probe(_whole_files(spark, path))


def parse_packets(documents: DataFrame, text: str = "json") -> DataFrame:
    """Packet rows of packet documents: position, time (bad or missing 0.0), size (0), flags ('')."""
    kept = [c for c in documents.columns if c != text]
    packets = F.from_json(F.col(text), PACKETS_SCHEMA)["packets"]
    return documents.select(*kept, F.posexplode(packets).alias("packet_idx", "_p")).select(
        *kept,
        F.col("packet_idx").cast("bigint").alias("packet_idx"),
        *_packet_fields(),
    )


def _packet_fields() -> list[Column]:
    return [
        F.coalesce(strict_double(F.col("_p.pts_time")), F.lit(0.0)).alias("pts_time"),
        _number(F.col("_p.size")).alias("size_bytes"),
        F.coalesce("_p.flags", F.lit("")).alias("flags"),
    ]


def _brackets(text: Column) -> Column:
    """The brackets of a text without strings and closing braces, balanced pairs taken out: closing ones, then opening ones."""
    out = F.regexp_replace(text, r"[^\[\]{]+", "")
    for _ in range(4):  # arrays in arrays
        out = F.replace(out, F.lit("[]"), F.lit(""))
    return out


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(asset_path, _block, _at, piece): the documents cut at every closing brace, as Spark splits the files."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("asset_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("piece"),
    )


def _placed_pieces(pieces: DataFrame) -> DataFrame:
    """(asset_path, _block, _at, packet_idx, opens, closes, fresh) of the pieces that belong to an element of ``packets``.

    What a piece means depends on what came before it: whether it starts inside a string, how deep, in which array. Each
    of these is a running sum or the last of its kind, over slices that are the splits of the file. The two readings of a
    piece, from inside and from outside a string, are made before it is known which one holds, as a few characters.
    """
    keys, block, order = ["asset_path"], F.col("_block"), ["_at"]
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    tail = F.regexp_replace(plain, r'^[^"]*("|$)', "")

    def reading(text: Column) -> Column:
        brackets = _brackets(F.regexp_replace(text, r'"[^"]*("|$)', ""))
        name = F.regexp_extract(text, r'"([^"]*)"\s*:\s*\[\s*\{', 1)
        return F.struct(brackets.alias("brackets"), name.alias("name"))

    quotes = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).cast("bigint")
    marks = written(pieces.select(*keys, "_block", "_at", quotes.alias("_n"), reading(plain).alias("_out"), reading(tail).alias("_in")))
    quoted = slices.running_sum(marks, keys, block, order, F.col("_n"), "_quotes")
    read = F.when((F.col("_quotes") - F.col("_n")) % 2 == 1, F.col("_in")).otherwise(F.col("_out"))
    ends = F.col("_quotes") % 2 == 0  # else the closing brace is a character of a string
    chosen = quoted.select(*keys, "_block", "_at", read.alias("_read"), ends.cast("bigint").alias("_ends"))
    brackets = F.col("_read.brackets")
    opened = F.ltrim(brackets, F.lit("]"))
    closed = F.length(brackets) - F.length(opened)
    stepped = chosen.withColumns({"_opened": opened, "_closed": closed})
    change = F.length("_opened") - F.col("_closed") - F.col("_ends")
    deep = written(slices.running_sum(stepped, keys, block, order, change.cast("bigint"), "_after"))
    # the depth at which the piece starts to open: 0 outside the document, 1 in its object, 2 in an array of that
    base = F.col("_after") + F.col("_ends") - F.length("_opened")
    low = deep.withColumn("_base", base)
    # an array of the document's object that this piece opens, down to an object in it
    array_here = F.substr("_opened", F.lit(2) - F.col("_base"), F.lit(2)) == "[{"
    name = F.when(F.col("_base") <= 1, F.when(array_here, F.col("_read.name")).otherwise(""))
    named = slices.inherit(
        low.withColumn("_name", name), keys, block, [F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_at"))).alias("_last")],
        lambda w: [F.last("_last", ignorenulls=True).over(slices.before(w)).alias("_earlier")],
    )
    run = slices.so_far(slices.in_slice(keys, order))
    inside = F.coalesce(F.last("_name", ignorenulls=True).over(run), F.col("_earlier")) == "packets"
    starts = (F.col("_base") <= 2) & (F.substr("_opened", F.lit(3) - F.col("_base"), F.lit(1)) == "{")
    found = named.withColumn("_packets", inside).where("_packets").withColumn("opens", starts)
    found = found.select(*keys, "_block", "_at", "_base", "_after", "opens")
    numbered = slices.running_sum(found, keys, block, order, F.col("opens").cast("bigint"), "_count")
    return numbered.where(F.col("opens") | (F.col("_base") >= 3)).select(
        *keys, "_block", "_at", (F.col("_count") - 1).alias("packet_idx"), "opens", (F.col("_after") == 2).alias("closes"),
        (F.col("_base") <= 1).alias("fresh"),
    )


def read_packets_json(spark: SparkSession, path: str) -> DataFrame:
    """Packet table of a folder of packet documents, one file per asset, of any length.

    Spark splits the files and cuts them at closing braces, in pretty-printed documents as in those of one line; most
    packets are one piece. A document in many splits is as many tasks' work. Elements of ``packets`` that are no objects
    have no row and no position. What holds no closing brace is one value: the part of a document between two of them.
    """
    return _packets_of(written(_pieces(spark, path)))


def _packets_of(pieces: DataFrame) -> DataFrame:
    place = ["asset_path", "_block", "_at"]
    found = pieces.join(_placed_pieces(pieces), place)
    lead = F.when(F.col("fresh"), F.regexp_replace("piece", r'(?s)^.*?"packets"\s*:\s*\[\s*(?=\{)', "")).otherwise(F.col("piece"))
    first = F.regexp_replace(lead, r"^[\s,]+", "")
    text = F.concat(F.when(F.col("opens"), first).otherwise(F.col("piece")), F.lit("}"))
    texts = found.select(*place, "packet_idx", text.alias("text"), "opens", "closes")
    whole = F.col("opens") & F.col("closes")
    # a packet of several pieces has objects or closing braces inside; it may lie across splits
    parts = texts.where(~whole).groupBy("asset_path", "packet_idx").agg(F.sort_array(F.collect_list(F.struct("_block", "_at", "text"))).alias("_parts"))
    joined = parts.select("asset_path", "packet_idx", F.array_join(F.col("_parts.text"), "").alias("text"))
    both = texts.where(whole).select("asset_path", "packet_idx", "text").unionByName(joined)
    parsed = both.select("asset_path", "packet_idx", F.from_json("text", PACKET_SCHEMA).alias("_p"))
    return parsed.select("asset_path", F.col("packet_idx").cast("bigint").alias("packet_idx"), *_packet_fields())
