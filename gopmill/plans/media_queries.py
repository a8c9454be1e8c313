"""GOPs, keyframes, decisions, segments, frames and packet selection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gopmill.operators import decisions, frames, gops, packets, segments
from gopmill.plans import adapters
from gopmill.plans.registry import query
from gopmill.session import written


def stored_gops(spark, folder):
    """The GOP table, stored once as a fleet would keep it: the queries below read it several times."""
    return written(gops.gop_stats(adapters.packets(spark, folder)))


@query("keyframes", "SELECT asset_id, kf_idx, frame_idx, ts FROM keyframes", ("keyframes",))
def keyframes(spark, folder):
    return gops.keyframes(adapters.packets(spark, folder))


@query("gop_ids", "SELECT asset_id, packet_idx, gop_idx FROM gop_ids", ("gop_ids",))
def gop_ids(spark, folder):
    return gops.gop_ids(adapters.packets(spark, folder)).select("asset_id", "packet_idx", "gop_idx")


@query(
    "gop_stats",
    """SELECT asset_id, gop_idx, start_frame, end_frame, start_time, end_time, size_bytes, round(bitrate_bps, 3) AS bitrate_bps FROM gops""",
    ("gops",),
)
def gop_stats(spark, folder):
    return gops.gop_stats(adapters.packets(spark, folder)).withColumn("bitrate_bps", F.round("bitrate_bps", 3))


@query(
    "gop_summary",
    """SELECT asset_id, round(avg(bitrate_bps), 3) AS avg_bitrate_bps, round(min(bitrate_bps), 3) AS min_bitrate_bps,
         round(max(bitrate_bps), 3) AS max_bitrate_bps, count(*) AS gop_count FROM gops GROUP BY asset_id""",
    ("gops",),
)
def gop_summary(spark, folder):
    summary = gops.gop_summary(gops.gop_stats(adapters.packets(spark, folder)))
    rates = ("avg_bitrate_bps", "min_bitrate_bps", "max_bitrate_bps")
    return summary.withColumns({c: F.round(c, 3) for c in rates})


@query(
    "auto_tolerance",
    "SELECT asset_id, round(target_bitrate, 2) AS target_bitrate, round(tolerance, 6) AS tolerance FROM tolerances",
    ("tolerances",),
)
def auto_tolerance(spark, folder):
    stats = gops.gop_stats(adapters.packets(spark, folder))
    tuned = gops.auto_tolerance(adapters.plain_media(spark, folder), stats, 0.3)
    return tuned.select("asset_id", F.round("target_bitrate", 2).alias("target_bitrate"), F.round("tolerance", 6).alias("tolerance"))


@query(
    "media_summary",
    """SELECT m.asset_id, duration_secs, width, height, fps, codec_name AS codec, profile, pix_fmt,
         round(avg(bitrate_bps), 3) AS avg_bitrate_bps, false AS has_audio
       FROM media m LEFT JOIN gops g USING (asset_id) GROUP BY ALL""",
    ("media", "gops"),
)
def media_summary(spark, folder):
    summary = gops.media_summary(adapters.media(spark, folder), gops.gop_stats(adapters.packets(spark, folder)))
    return summary.withColumn("avg_bitrate_bps", F.round("avg_bitrate_bps", 3))


def ranges(spark, folder):
    """Ten-second ranges over every asset that has packets."""
    cut = segments.fixed_segments(adapters.packet_media(spark, folder), 10.0)
    return cut.select("asset_id", "segment_id", "start_ts", "end_ts")


RANGES = """ranges AS (
 SELECT asset_id, segment_id, segment_id * CAST(10 AS DOUBLE) AS start_ts, least((segment_id + 1) * CAST(10 AS DOUBLE), duration_secs) AS end_ts
 FROM (SELECT asset_id, duration_secs, unnest(range(CAST(ceil(duration_secs / 10) AS BIGINT))) AS segment_id FROM packet_media))"""
adapters.CTES["ranges"] = (("packet_media",), RANGES)
adapters.CTES["plan"] = (
    ("ranges", "gops", "tolerances"),
    """plan AS (
 SELECT r.asset_id, r.segment_id, r.start_ts, r.end_ts, t.target_bitrate, t.blocked, t.tolerance AS tuned,
        avg(g.bitrate_bps) / t.target_bitrate AS ratio
 FROM ranges r JOIN tolerances t USING (asset_id)
 LEFT JOIN gops g ON g.asset_id = r.asset_id AND g.start_time < r.end_ts AND g.end_time > r.start_ts
 GROUP BY r.asset_id, r.segment_id, r.start_ts, r.end_ts, t.target_bitrate, t.blocked, t.tolerance)""",
)


@query(
    "gops_in_ranges",
    """SELECT r.asset_id, r.segment_id, g.gop_idx FROM ranges r JOIN gops g
       ON g.asset_id = r.asset_id AND g.start_time < r.end_ts AND g.end_time > r.start_ts""",
    ("ranges", "gops"),
)
def gops_in_ranges(spark, folder):
    found = decisions.gops_in_ranges(ranges(spark, folder), stored_gops(spark, folder))
    return found.select("asset_id", "segment_id", "gop_idx")


@query(
    "gops_in_open_ranges",
    """SELECT r.asset_id, r.segment_id, g.gop_idx FROM
         (SELECT asset_id, segment_id, start_ts, CASE WHEN segment_id % 5 = 0 THEN 9.2e10 ELSE end_ts END AS end_ts FROM ranges) r
       JOIN gops g ON g.asset_id = r.asset_id AND g.start_time < r.end_ts AND g.end_time > r.start_ts""",
    ("ranges", "gops"),
)
def gops_in_open_ranges(spark, folder):
    """Every fifth range without an end: 9.2e10 seconds."""
    end = F.when(F.col("segment_id") % 5 == 0, 9.2e10).otherwise(F.col("end_ts"))
    found = decisions.gops_in_ranges(ranges(spark, folder).withColumn("end_ts", end), stored_gops(spark, folder))
    return found.select("asset_id", "segment_id", "gop_idx")


def _plan(spark, folder, mode, tolerance=0.3):
    smart = mode in decisions.SMART_MODES
    stats = stored_gops(spark, folder) if smart else gops.gop_stats(adapters.packets(spark, folder))
    return decisions.plan_segments(adapters.plain_media(spark, folder), ranges(spark, folder), stats, mode, tolerance)


def _plan_columns(plan):
    return plan.select(
        "asset_id", "segment_id", "copy", F.round("bitrate_ratio", 6).alias("bitrate_ratio"),
        F.size("blockers").alias("blockers"), F.round("tolerance", 6).alias("tolerance"),
        F.round("target_bitrate", 2).alias("target_bitrate"),
    )


def _plan_sql(copy, ratio="round(ratio, 6)", blockers="CASE WHEN blocked THEN 1 ELSE 0 END", tolerance="CAST(0.3 AS DOUBLE)"):
    return f"""SELECT asset_id, segment_id, {copy} AS copy, {ratio} AS bitrate_ratio, {blockers} AS blockers,
      {tolerance} AS tolerance, round(target_bitrate, 2) AS target_bitrate FROM plan"""


@query("plan_segments_normal", _plan_sql("false", "CAST(NULL AS DOUBLE)", "0"), ("plan",))
def plan_normal(spark, folder):
    return _plan_columns(_plan(spark, folder, "normal"))


@query("plan_segments_copy", _plan_sql("true", "CAST(NULL AS DOUBLE)", "0"), ("plan",))
def plan_copy(spark, folder):
    return _plan_columns(_plan(spark, folder, "copy"))


@query(
    "plan_segments_smart",
    _plan_sql("NOT blocked AND coalesce(ratio BETWEEN 1 - CAST(0.3 AS DOUBLE) AND 1 + CAST(0.3 AS DOUBLE), false)"),
    ("plan",),
)
def plan_smart(spark, folder):
    return _plan_columns(_plan(spark, folder, "smart"))


@query(
    "plan_segments_smart_auto",
    _plan_sql("NOT blocked AND coalesce(ratio BETWEEN 1 - tuned AND 1 + tuned, false)", tolerance="round(tuned, 6)"),
    ("plan",),
)
def plan_smart_auto(spark, folder):
    return _plan_columns(_plan(spark, folder, "smart-auto"))


@query(
    "recommend",
    """SELECT asset_id, CASE WHEN blocked OR share IS NULL THEN 'normal' WHEN share >= 0.9 THEN 'copy' WHEN share <= 0.1 THEN 'normal' ELSE 'smart-auto' END AS mode,
         CASE WHEN work <= 120 THEN 'slow' WHEN work <= 900 THEN 'medium' WHEN work <= 3600 THEN 'fast' ELSE 'veryfast' END AS preset,
         CASE WHEN blocked THEN 're-encode everything: source codec hevc differs from target h264'
              WHEN share IS NULL THEN 'no GOP bitrate data; re-encode everything'
              WHEN share >= 0.9 THEN CAST(round(share * 100) AS BIGINT) || '% of GOPs within ±' || CAST(round(tolerance * 100) AS BIGINT) || '% of the target bitrate; stream-copy'
              WHEN share <= 0.1 THEN 'only ' || CAST(round(share * 100) AS BIGINT) || '% of GOPs near the target bitrate; re-encode everything'
              ELSE CAST(round(share * 100) AS BIGINT) || '% of GOPs near the target bitrate; copy those, re-encode the rest' END AS reason,
         'preset ' || CASE WHEN work <= 120 THEN 'slow' WHEN work <= 900 THEN 'medium' WHEN work <= 3600 THEN 'fast' ELSE 'veryfast' END
           || ': about ' || CAST(round(work / 60) AS BIGINT) || ' min of 1080p30-equivalent work' AS preset_reason,
         CASE WHEN NOT blocked THEN round(share, 6) END AS copyable_gop_fraction
       FROM (SELECT m.asset_id, t.blocked, t.tolerance, CAST(m.width AS DOUBLE) * m.height * m.fps * m.duration_secs / CAST(62208000 AS DOUBLE) AS work,
               avg(CASE WHEN abs(g.bitrate_bps / t.target_bitrate - 1) <= t.tolerance THEN 1 WHEN g.gop_idx IS NOT NULL THEN 0 END) AS share
             FROM plain_media m JOIN tolerances t USING (asset_id) LEFT JOIN gops g USING (asset_id) GROUP BY ALL)""",
    ("tolerances",),
)
def recommend(spark, folder):
    advice = decisions.recommend(adapters.plain_media(spark, folder), stored_gops(spark, folder), 0.3)
    return advice.select(
        "asset_id", "mode", "preset", F.col("reasons")[0].alias("reason"), F.col("reasons")[1].alias("preset_reason"),
        F.round("copyable_gop_fraction", 6).alias("copyable_gop_fraction"),
    )


COPY_RULE = "NOT blocked AND coalesce(ratio BETWEEN 1 - CAST(0.3 AS DOUBLE) AND 1 + CAST(0.3 AS DOUBLE), false)"


@query(
    "segment_reasons",
    f"""SELECT asset_id, segment_id, CASE WHEN {COPY_RULE} THEN 'copy' ELSE 'encode' END AS decision,
         concat_ws('; ', CASE WHEN blocked THEN 'source codec hevc differs from target h264' END,
           CASE WHEN ratio IS NULL THEN 'no GOP data' WHEN NOT ratio BETWEEN 1 - CAST(0.3 AS DOUBLE) AND 1 + CAST(0.3 AS DOUBLE)
                THEN 'bitrate ratio ' || printf('%.2f', ratio) || ' outside ±30%' END) AS reasons FROM plan""",
    ("plan",),
)
def segment_reasons(spark, folder):
    reasons = decisions.segment_reasons(_plan(spark, folder, "smart"), 0.3)
    return reasons.select("asset_id", "segment_id", "decision", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "report_summary",
    f"""SELECT asset_id, count(*) AS total_segments, count(*) FILTER ({COPY_RULE}) AS copy_segments,
         count(*) FILTER (NOT ({COPY_RULE})) AS encode_segments,
         CASE WHEN blocked THEN 'source codec hevc differs from target h264' ELSE '' END AS global_blockers FROM plan GROUP BY asset_id, blocked""",
    ("plan",),
)
def report_summary(spark, folder):
    summary = decisions.report_summary(_plan(spark, folder, "smart"))
    return summary.withColumn("global_blockers", F.array_join("global_blockers", "; "))


@query(
    "nearest_keyframe",
    """SELECT asset_id, target_frame, (SELECT k.kf_idx FROM keyframes k WHERE k.asset_id = t.asset_id
              ORDER BY abs(k.frame_idx - t.target_frame), k.frame_idx LIMIT 1) AS kf_idx
       FROM (SELECT asset_id, packet_idx + 125 AS target_frame FROM packets) t""",
    ("keyframes",),
)
def nearest_keyframe(spark, folder):
    packed = adapters.packets(spark, folder)
    targets = packed.select("asset_id", (F.col("packet_idx") + 125).alias("target_frame"))
    return segments.nearest_keyframe(targets, gops.keyframes(packed)).select("asset_id", "target_frame", "kf_idx")


def cut(spark, folder):
    return segments.create_segments(
        adapters.packet_media(spark, folder), gops.keyframes(adapters.packets(spark, folder)), adapters.TARGET_SECS
    )


@query(
    "create_segments",
    "SELECT asset_id, segment_id, start_frame, end_frame, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts FROM cuts",
    ("cuts",),
)
def create_segments(spark, folder):
    return cut(spark, folder).withColumns({"start_ts": F.round("start_ts", 6), "end_ts": F.round("end_ts", 6)})


@query(
    "segment_rejects",
    """SELECT m.asset_id, 'No keyframes detected' AS reason FROM packet_media m
       WHERE m.asset_id NOT IN (SELECT asset_id FROM packets WHERE contains(flags, 'K') AND asset_id % 3 <> 0)""",
    ("packets", "packet_media"),
)
def segment_rejects(spark, folder):
    """Decoded form without the inserted keyframe; every third asset's packets come without the keyframe flag."""
    flags = F.when(F.col("asset_id") % 3 == 0, F.translate("flags", "K", "_")).otherwise(F.col("flags"))
    found = gops.keyframes(adapters.packets(spark, folder).withColumn("flags", flags), insert_zero=False)
    return segments.segment_rejects(adapters.packet_media(spark, folder), found, adapters.TARGET_SECS)


@query(
    "fixed_segments",
    """SELECT asset_id, segment_id, start_ts, round(end_ts, 6) AS end_ts, CAST(floor(greatest((end_ts - start_ts) * 30, 1)) AS BIGINT) AS end_frame FROM ranges""",
    ("ranges",),
)
def fixed_segments(spark, folder):
    made = segments.fixed_segments(adapters.packet_media(spark, folder), 10.0)
    return made.select("asset_id", "segment_id", "start_ts", F.round("end_ts", 6).alias("end_ts"), "end_frame")


@query(
    "size_segments",
    """SELECT asset_id, segment_id, segment_id * 300 AS start_frame, (segment_id + 1) * 300 AS end_frame,
         segment_id * CAST(10 AS DOUBLE) AS start_ts, round(least((segment_id + 1) * CAST(10 AS DOUBLE), lasted), 6) AS end_ts
       FROM (SELECT asset_id, lasted, unnest(range(greatest(CAST(ceil(lasted / 10) AS BIGINT), 1))) AS segment_id
             FROM (SELECT p_partkey AS asset_id, p_partkey * 100000 / CAST(5242880 AS DOUBLE) AS lasted FROM part))""",
)
def size_segments(spark, folder):
    sources = adapters.read_parquet(spark, folder, "part").select(
        F.col("p_partkey").alias("asset_id"), (F.col("p_partkey") * 100000).alias("size_bytes")
    )
    made = segments.size_segments(sources)
    return made.select("asset_id", "segment_id", "start_frame", "end_frame", "start_ts", F.round("end_ts", 6).alias("end_ts"))


@query(
    "frames_in_segments",
    """SELECT c.asset_id, c.segment_id, round(coalesce(avg(f.complexity), 0), 6) AS complexity_estimate,
         count(*) FILTER (f.is_scene_change) AS scene_change_count
       FROM cuts c LEFT JOIN frames f ON f.asset_id = c.asset_id AND f.frame_idx BETWEEN c.start_frame AND c.end_frame GROUP BY ALL""",
    ("cuts", "frames"),
)
def frames_in_segments(spark, folder):
    measured = segments.frames_in_segments(cut(spark, folder), adapters.frames(spark, folder))
    return measured.select(
        "asset_id", "segment_id", F.round("complexity_estimate", 6).alias("complexity_estimate"), "scene_change_count"
    )


@query(
    "scene_changes_in_segments",
    """SELECT c.asset_id, c.segment_id, f.frame_idx FROM cuts c
       JOIN frames f ON f.asset_id = c.asset_id AND f.frame_idx BETWEEN c.start_frame AND c.end_frame WHERE f.is_scene_change""",
    ("cuts", "frames"),
)
def scene_changes_in_segments(spark, folder):
    return segments.scene_changes_in_segments(cut(spark, folder), adapters.frames(spark, folder))


@query(
    "max_segment_duration",
    "SELECT asset_id, CAST(ceil(max(end_ts - start_ts)) AS BIGINT) AS target_duration FROM cuts GROUP BY asset_id",
    ("cuts",),
)
def max_segment_duration(spark, folder):
    return segments.max_segment_duration(cut(spark, folder))


@query(
    "hardest_segments",
    "SELECT job_id, segment_id, complexity_estimate FROM segments ORDER BY complexity_estimate DESC, job_id, segment_id LIMIT 50",
    ("segments",),
)
def hardest_segments(spark, folder):
    return segments.hardest_segments(adapters.segments(spark, folder), 50)


@query(
    "hardest_segments_per_job",
    """SELECT * FROM (SELECT job_id, segment_id, complexity_estimate,
         row_number() OVER (PARTITION BY job_id ORDER BY complexity_estimate DESC, segment_id) AS rank FROM segments) WHERE rank <= 20""",
    ("segments",),
)
def hardest_segments_per_job(spark, folder):
    return segments.hardest_segments_per_job(adapters.segments(spark, folder), 20)


def _units():
    return F.round(F.col("complexity") * 16384000).cast("bigint").alias("complexity_units")


def _with_histogram(measured):
    thousandths = F.transform("histogram", lambda share: F.round(share * 1000).cast("bigint").cast("string"))
    return measured.select("asset_id", "frame_idx", _units(), F.array_join(thousandths, ",").alias("histogram"))


def _planes(spark, folder):
    plane = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5)), 2, "0")), ""))
    return adapters.read_parquet(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("asset_id"), F.col("vec_id").alias("frame_idx"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(8).alias("stride"), plane.alias("gray"),
    )


@query(
    "frame_features",
    """SELECT b.asset_id, b.frame_idx, CAST(round(any_value(f.complexity) * 16384000) AS BIGINT) AS complexity_units,
         string_agg(CAST(CAST(round(share * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS histogram
       FROM bins b JOIN features f USING (asset_id, frame_idx) GROUP BY b.asset_id, b.frame_idx""",
    ("bins", "features"),
)
def frame_features(spark, folder):
    """Histogram in thousandths and complexity in its 64-pixel steps: whole numbers compare exactly."""
    return _with_histogram(frames.features_from_pixels(adapters.pixels(spark, folder)))


BINARY_SQL = """SELECT b.asset_id, b.frame_idx, CAST(round(any_value(f.complexity) * 16384000) AS BIGINT) AS complexity_units,
         string_agg(CAST(CAST(round(share * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS histogram
       FROM bins b JOIN features f USING (asset_id, frame_idx) GROUP BY b.asset_id, b.frame_idx"""


@query("frame_features_binary", BINARY_SQL, ("bins", "features"))
def frame_features_binary(spark, folder):
    """The same from packed 8x8 planes."""
    return _with_histogram(frames.frame_features(_planes(spark, folder)))


@query(
    "frame_features_binary_histogram",
    """SELECT b.asset_id, b.frame_idx, CAST(round(any_value(f.complexity) * 16384000) AS BIGINT) AS complexity_units,
         string_agg(CAST(CAST(round(share * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS histogram
       FROM bins b JOIN features f USING (asset_id, frame_idx) GROUP BY b.asset_id, b.frame_idx""",
    ("bins", "features"),
)
def frame_features_binary_histogram(spark, folder):
    """Complexity and histogram of the same planes."""
    return _with_histogram(frames.frame_features(_planes(spark, folder)))


def _changes(spark, folder):
    features = written(frames.features_from_pixels(adapters.pixels(spark, folder)))
    return frames.scene_changes(features, threshold=0.15)


@query(
    "scene_changes",
    "SELECT asset_id, frame_idx, CAST(floor(distance * 1000003) AS BIGINT) AS distance_units, is_scene_change FROM changes",
    ("changes",),
)
def scene_changes(spark, folder):
    """Distance in steps of one over a prime: shares of 64 pixels fall on no step but 0, so engines cannot differ on a tie."""
    steps = F.floor(F.col("distance") * 1000003).cast("bigint").alias("distance_units")
    return _changes(spark, folder).select("asset_id", "frame_idx", steps, "is_scene_change")


@query(
    "analysis_counts",
    """SELECT asset_id, count(*) AS frames, count(*) FILTER (frame_idx % 12 = 0) AS keyframes,
         count(*) FILTER (is_scene_change) AS scene_changes FROM changes GROUP BY asset_id""",
    ("changes",),
)
def analysis_counts(spark, folder):
    return frames.analysis_counts(_changes(spark, folder).withColumn("is_key", F.col("frame_idx") % 12 == 0))


@query(
    "packets_in_segments",
    """SELECT p.asset_id, p.packet_idx, c.segment_id FROM packets p JOIN cuts c ON c.asset_id = p.asset_id
         AND (p.pts_time >= c.start_ts - 0.001 OR c.start_ts < 0.1) AND p.pts_time <= c.end_ts + 0.001""",
    ("packets", "cuts"),
)
def packets_in_segments(spark, folder):
    held = packets.packets_in_segments(adapters.packets(spark, folder), written(cut(spark, folder)), "video")
    return held.select("asset_id", "packet_idx", "segment_id")


@query(
    "packets_in_segments_audio",
    """SELECT p.asset_id, p.packet_idx, c.segment_id FROM packets p JOIN cuts c ON c.asset_id = p.asset_id
         AND p.packet_idx % 9 <> 0 AND p.pts_time >= c.start_ts - 0.001 AND p.pts_time <= c.end_ts + 0.001
       UNION ALL SELECT asset_id, packet_idx, NULL FROM packets WHERE packet_idx % 9 = 0""",
    ("packets", "cuts"),
)
def packets_in_segments_audio(spark, folder):
    """Every ninth packet has no time."""
    sound = adapters.packets(spark, folder).withColumn("pts_time", F.when(F.col("packet_idx") % 9 != 0, F.col("pts_time")))
    held = packets.packets_in_segments(sound, written(cut(spark, folder)), "audio")
    return held.select("asset_id", "packet_idx", "segment_id")


@query(
    "untimed_audio_in_segments",
    "SELECT p.asset_id, p.packet_idx, c.segment_id FROM packets p JOIN cuts c ON c.asset_id = p.asset_id WHERE p.packet_idx % 9 = 0",
    ("packets", "cuts"),
)
def untimed_audio_in_segments(spark, folder):
    """The packets without a time as rows of every segment."""
    sound = adapters.packets(spark, folder).withColumn("pts_time", F.when(F.col("packet_idx") % 9 != 0, F.col("pts_time")))
    numbered = sound.select("asset_id", "packet_idx", "pts_time")
    return packets.untimed_audio_in_segments(numbered, cut(spark, folder)).select("asset_id", "packet_idx", "segment_id")


def streams(spark, folder):
    """Three streams per asset of ``packets``: video, audio, audio."""
    media = adapters.packet_media(spark, folder)
    index = F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("stream_index")
    return media.select("asset_id", index).select(
        "asset_id", "stream_index",
        F.when(F.col("stream_index") == 0, "video").otherwise("audio").alias("kind"),
        F.when(
            (F.col("asset_id") == 7) & (F.col("stream_index") == 1), None
        ).otherwise(F.lit(1.4) - F.col("stream_index") * F.col("asset_id") / 10.0).alias("start_secs"),
        (F.col("asset_id") / 10.0).alias("origin_secs"), F.lit(1).alias("tb_num"), F.lit(90000).alias("tb_den"),
    )


adapters.CTES["streams"] = (
    ("packet_media",),
    """streams AS (
 SELECT asset_id, stream_index, CASE WHEN stream_index = 0 THEN 'video' ELSE 'audio' END AS kind,
   CASE WHEN asset_id = 7 AND stream_index = 1 THEN NULL ELSE CAST(1.4 AS DOUBLE) - stream_index * asset_id / CAST(10 AS DOUBLE) END AS start_secs,
   asset_id / CAST(10 AS DOUBLE) AS origin_secs, 1 AS tb_num, 90000 AS tb_den
 FROM (SELECT asset_id, unnest(range(3)) AS stream_index FROM packet_media))""",
)


@query(
    "rebased_packets",
    """SELECT asset_id, packet_idx, pts - origin AS pts, dts - origin AS dts FROM (
         SELECT asset_id, packet_idx, CASE WHEN packet_idx % 11 <> 0 THEN packet_idx * 3600 END AS pts, packet_idx * 3600 - 1800 AS dts,
                asset_id * 9000 AS origin FROM packets) WHERE pts IS NULL OR pts >= origin""",
    ("packets",),
)
def rebased_packets(spark, folder):
    timed = adapters.packets(spark, folder).select(
        "asset_id", "packet_idx", (F.col("packet_idx") % 3).alias("stream_index"),
        F.when(F.col("packet_idx") % 11 != 0, F.col("packet_idx") * 3600).alias("pts"),
        (F.col("packet_idx") * 3600 - 1800).alias("dts"),
    )
    return packets.rebased_packets(timed, streams(spark, folder)).select("asset_id", "packet_idx", "pts", "dts")


@query(
    "audio_lead",
    """SELECT asset_id, round(CASE WHEN asset_id = 7 THEN 0 ELSE asset_id / CAST(10 AS DOUBLE) END, 6) AS lead_secs FROM packet_media""",
    ("packet_media",),
)
def audio_lead(spark, folder):
    return packets.audio_lead(streams(spark, folder)).withColumn("lead_secs", F.round("lead_secs", 6))


@query(
    "lead_trimmed_audio",
    """SELECT asset_id, packet_idx FROM packets WHERE NOT (packet_idx % 2 = 1 AND asset_id NOT IN (0, 7) AND pts_time < 1.4)""",
    ("packets",),
)
def lead_trimmed_audio(spark, folder):
    kinds = adapters.packets(spark, folder).withColumn("kind", F.when(F.col("packet_idx") % 2 == 1, "audio").otherwise("video"))
    return packets.lead_trimmed_audio(kinds, streams(spark, folder)).select("asset_id", "packet_idx")
