"""The given tables seen as the tables of a video-processing fleet, for Spark and as SQL for the check.

Positions inside a group are counted by slices of the unique ``event_id`` or ``o_orderkey``, so that no adapter runs
a window over a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gopmill.operators import slices
from gopmill.sources.tables import read_parquet

FPS = 25.0
TARGET_SECS = 5.0


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Ten assets at 25 fps, a keyframe every 40 packets or so, about 2 Mbit/s."""
    events = read_parquet(spark, folder, "events").select(
        F.expr("user_id % 10").alias("asset_id"), "event_id", "event_type", "value"
    )
    placed = slices.row_number(
        events, ["asset_id"], slices.slice_of("event_id"), ["event_id"], "packet_idx", start=0
    )
    key = (F.col("event_type") == "signup") & (F.col("event_id") % 8 == 0)
    return placed.select(
        "asset_id", "packet_idx",
        (F.col("packet_idx").cast("double") / F.lit(FPS)).alias("pts_time"),
        F.round(F.col("value") * 200).cast("bigint").alias("size_bytes"),
        F.when(key, "K__").otherwise("___").alias("flags"),
    )


def packet_media(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the assets of ``packets``."""
    events = read_parquet(spark, folder, "events")
    return (
        events.groupBy(F.expr("user_id % 10").alias("asset_id"))
        .agg(F.count(F.lit(1)).alias("total_frames"))
        .select("asset_id", F.lit(FPS).alias("fps"), "total_frames", (F.col("total_frames") / FPS).alias("duration_secs"))
    )


MEDIA_COLUMNS = """p_partkey AS asset_id,
 CASE p_size % 4 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 ELSE 640 END AS width,
 CASE p_size % 4 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 ELSE 480 END AS height,
 CAST(CASE p_size % 3 WHEN 0 THEN 24 WHEN 1 THEN 25 ELSE 30 END AS DOUBLE) AS fps,
 p_retailprice AS duration_secs,
 CASE p_partkey % 4 WHEN 0 THEN 'hevc' ELSE 'h264' END AS codec_name,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Baseline' WHEN 2 THEN 'Main' ELSE 'High' END AS profile,
 CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt,
 CASE p_partkey % 11 WHEN 0 THEN 'libx264' WHEN 1 THEN 'h264_videotoolbox' WHEN 2 THEN 'h264_nvenc' WHEN 3 THEN 'h264_vaapi'
   WHEN 4 THEN 'libx265' WHEN 5 THEN 'hevc_videotoolbox' WHEN 6 THEN 'hevc_nvenc' WHEN 7 THEN 'hevc_vaapi'
   WHEN 8 THEN 'libsvtav1' WHEN 9 THEN 'libaom-av1' ELSE 'av1_nvenc' END AS encoder,
 CASE p_partkey % 9 WHEN 0 THEN 'ultrafast' WHEN 1 THEN 'superfast' WHEN 2 THEN 'veryfast' WHEN 3 THEN 'faster'
   WHEN 4 THEN 'fast' WHEN 5 THEN 'medium' WHEN 6 THEN 'slow' WHEN 7 THEN 'slower' ELSE '11' END AS preset,
 CAST(18 + p_partkey % 15 AS INT) AS crf"""


def media(spark: SparkSession, folder: str) -> DataFrame:
    """Every resolution tier, encoder, profile and pixel format; assets 0-9 have packets."""
    return read_parquet(spark, folder, "part").selectExpr(*_columns(MEDIA_COLUMNS))


def plain_media(spark: SparkSession, folder: str) -> DataFrame:
    """``media`` as SD sources that libx264 may copy, so that GOP rates decide; asset 3 stays blocked."""
    return read_parquet(spark, folder, "part").selectExpr(*_columns(PLAIN_MEDIA_COLUMNS))


PLAIN_MEDIA_COLUMNS = """p_partkey AS asset_id, 640 AS width, 480 AS height, CAST(25 AS DOUBLE) AS fps,
 p_retailprice AS duration_secs, CASE WHEN p_partkey % 10 = 3 THEN 'hevc' ELSE 'h264' END AS codec_name,
 'High' AS profile, 'yuv420p' AS pix_fmt, 'libx264' AS encoder, CAST(20 + p_partkey % 6 AS INT) AS crf"""


def _columns(text: str) -> list[str]:
    """Top-level comma-separated expressions of a select list."""
    parts, depth, current = [], 0, ""
    for char in text:
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


NODE_COLUMNS = """s_suppkey AS node_id, CAST(1 + s_suppkey % 16 AS INT) AS cpu_cores,
 CAST(1 + s_suppkey % 8 AS INT) AS max_concurrent_workers, CAST(s_nationkey % 5 AS INT) AS active_workers,
 CAST(1024 * (1 + s_suppkey % 16) AS INT) AS memory_mb,
 CASE s_suppkey % 5 WHEN 0 THEN 'Joining' WHEN 1 THEN 'Draining' WHEN 2 THEN 'Dead' WHEN 3 THEN 'Busy' ELSE 'Active' END AS status"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every status; some nodes are full."""
    return read_parquet(spark, folder, "supplier").selectExpr(*_columns(NODE_COLUMNS))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty jobs with a complexity per segment, rounded so that ties occur."""
    orders = read_parquet(spark, folder, "orders").select(
        F.expr("o_custkey % 20").alias("job_id"), "o_orderkey",
        (F.round(F.col("o_totalprice") / 500.0) / 1000.0).alias("complexity_estimate"),
    )
    return slices.row_number(
        orders, ["job_id"], slices.slice_of("o_orderkey"), ["o_orderkey"], "segment_id", start=0
    ).select("job_id", "segment_id", "complexity_estimate")


def segment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with repeats per (job, segment); ``seq`` is a struct that orders them all."""
    return read_parquet(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("segment_id"),
        F.struct("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"),
        F.col("l_suppkey").alias("node_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'R' THEN 'failed' ELSE 'assign' END").alias("kind"),
        (F.col("l_quantity").cast("bigint") * 10).alias("frames_encoded"),
        F.round("l_extendedprice").cast("bigint").alias("output_size_bytes"),
        (F.col("l_quantity") / 4.0).alias("encoding_time_secs"),
    )


def job_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Seven segments planned per job; jobs with fewer reports have pending ones."""
    return read_parquet(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(7).cast("bigint").alias("total"))


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Roughly ten hours between beats, so liveness runs with a timeout of twelve."""
    return read_parquet(spark, folder, "events").select(
        F.col("user_id").alias("node_id"), "ts",
        (F.floor("value").cast("int") % 9).alias("active_workers"),
        F.lit(8).alias("max_concurrent_workers"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per event; every branch of the phase table."""
    return log_lines_of(read_parquet(spark, folder, "events"))


def log_lines_of(events: DataFrame) -> DataFrame:
    line = F.expr(
        """CASE WHEN event_id % 97 = 0 THEN 'INFO presplit_0001.ts pre-split'
                WHEN event_id % 89 = 0 THEN 'INFO Pipeline complete:'
                WHEN event_type = 'signup' THEN concat('INFO Created ', CAST(1 + event_id % 12 AS STRING), ' segments')
                WHEN event_type = 'click'  THEN concat('INFO Segment ', CAST(event_id % 12 AS STRING), ' done: 300 frames')
                WHEN event_type = 'view'   THEN 'INFO Encoding frame batch'
                WHEN event_type = 'error'  THEN 'INFO Step 4: Assembling output...'
                ELSE 'INFO Step 1: Analyzing video...' END"""
    )
    return events.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), line.alias("line"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each validation rule fails for some rows; some formats are absent."""
    return requests_of(read_parquet(spark, folder, "orders"))


def requests_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*_columns(REQUEST_COLUMNS))


REQUEST_COLUMNS = """o_orderkey AS request_id,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('up_', CAST(o_custkey AS STRING), '.mp4') END AS upload_id,
 CASE o_orderstatus WHEN 'F' THEN 'mp4' WHEN 'O' THEN 'hls' ELSE NULL END AS format,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'copy' WHEN '2-HIGH' THEN 'smart' WHEN '3-MEDIUM' THEN 'turbo' ELSE 'normal' END AS mode,
 CASE WHEN o_orderkey % 17 = 0 THEN 'libx263' ELSE 'libx264' END AS encoder,
 CASE WHEN o_orderkey % 19 = 0 THEN '13' ELSE '12' END AS preset,
 CAST(o_orderkey % 70 AS INT) AS crf, CAST(o_orderkey % 11 AS INT) AS workers,
 CAST(o_orderkey % 120 AS DOUBLE) / CAST(100 AS DOUBLE) AS smart_tolerance"""


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 answers of hosts, public and blocked."""
    first = F.expr(
        "CASE c_custkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 169 WHEN 4 THEN 100 ELSE 8 END"
    )
    parts = [first, F.expr("(c_custkey * 7) % 256"), F.expr("(c_custkey * 13) % 256"), F.expr("c_custkey % 256")]
    return read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("source_id"),
        F.col("c_nationkey").alias("host_id"),
        F.concat_ws(".", *[part.cast("string") for part in parts]).alias("address"),
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """64 gray values per frame; a label is an asset, vec_id orders its frames."""
    return read_parquet(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("asset_id"),
        F.col("vec_id").alias("frame_idx"),
        F.explode("embedding").alias("x"),
    ).select("asset_id", "frame_idx", F.floor((F.col("x").cast("double") + 1) * 127.5).cast("int").alias("gray"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of ``packets`` with a complexity and scene-change flag."""
    return packets(spark, folder).select(
        "asset_id", F.col("packet_idx").alias("frame_idx"),
        (F.col("size_bytes") / 40007.0).alias("complexity"),
        (F.col("size_bytes") % 23 == 0).alias("is_scene_change"),
        F.col("flags").contains("K").alias("is_key"),
    )


# name -> (needed names, DuckDB text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "packets": (
        (),
        """packets AS (
 SELECT asset_id, packet_idx, CAST(packet_idx AS DOUBLE) / CAST(25 AS DOUBLE) AS pts_time, size_bytes, flags FROM (
  SELECT user_id % 10 AS asset_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS packet_idx,
         CAST(round(value * 200) AS BIGINT) AS size_bytes,
         CASE WHEN event_type = 'signup' AND event_id % 8 = 0 THEN 'K__' ELSE '___' END AS flags FROM events))""",
    ),
    "packet_media": (
        (),
        """packet_media AS (
 SELECT user_id % 10 AS asset_id, CAST(25 AS DOUBLE) AS fps, count(*) AS total_frames,
        count(*) / CAST(25 AS DOUBLE) AS duration_secs FROM events GROUP BY user_id % 10)""",
    ),
    "media": ((), "media AS (SELECT " + MEDIA_COLUMNS + " FROM part)"),
    "plain_media": ((), "plain_media AS (SELECT " + PLAIN_MEDIA_COLUMNS + " FROM part)"),
    "nodes": ((), "nodes AS (SELECT " + NODE_COLUMNS + " FROM supplier)"),
    "segments": (
        (),
        """segments AS (
 SELECT o_custkey % 20 AS job_id, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS segment_id,
        round(o_totalprice / CAST(500 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS complexity_estimate FROM orders)""",
    ),
    "segment_events": (
        (),
        """segment_events AS (
 SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS segment_id, l_suppkey AS node_id,
        CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'R' THEN 'failed' ELSE 'assign' END AS kind,
        CAST(l_quantity AS BIGINT) * 10 AS frames_encoded, CAST(round(l_extendedprice) AS BIGINT) AS output_size_bytes,
        l_quantity / CAST(4 AS DOUBLE) AS encoding_time_secs,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) AS back
 FROM lineitem)""",
    ),
    "latest": (("segment_events",), "latest AS (SELECT * FROM segment_events WHERE back = 1)"),
    "totals": ((), "totals AS (SELECT o_orderkey AS job_id, CAST(7 AS BIGINT) AS total FROM orders)"),
    "progress": (
        ("latest", "totals"),
        """progress AS (
 SELECT t.job_id, t.total, coalesce(c.completed, 0) AS completed, coalesce(c.failed, 0) AS failed,
        coalesce(c.assigned, 0) AS assigned,
        greatest(t.total - coalesce(c.completed, 0) - coalesce(c.failed, 0) - coalesce(c.assigned, 0), 0) AS pending
 FROM totals t LEFT JOIN (
  SELECT job_id, count(*) FILTER (kind = 'complete') AS completed, count(*) FILTER (kind = 'failed') AS failed,
         count(*) FILTER (kind = 'assign') AS assigned FROM latest GROUP BY job_id) c USING (job_id))""",
    ),
    "heartbeats": (
        (),
        """heartbeats AS (
 SELECT user_id AS node_id, ts, CAST(floor(value) AS INT) % 9 AS active_workers, 8 AS max_concurrent_workers FROM events)""",
    ),
    "log_lines": (
        (),
        """log_lines AS (
 SELECT user_id AS job_id, ts, event_id AS seq,
   CASE WHEN event_id % 97 = 0 THEN 'INFO presplit_0001.ts pre-split'
        WHEN event_id % 89 = 0 THEN 'INFO Pipeline complete:'
        WHEN event_type = 'signup' THEN concat('INFO Created ', CAST(1 + event_id % 12 AS STRING), ' segments')
        WHEN event_type = 'click'  THEN concat('INFO Segment ', CAST(event_id % 12 AS STRING), ' done: 300 frames')
        WHEN event_type = 'view'   THEN 'INFO Encoding frame batch'
        WHEN event_type = 'error'  THEN 'INFO Step 4: Assembling output...'
        ELSE 'INFO Step 1: Analyzing video...' END AS line FROM events)""",
    ),
    "requests": ((), "requests AS (SELECT " + REQUEST_COLUMNS + " FROM orders)"),
    "addresses": (
        (),
        """addresses AS (
 SELECT c_custkey AS source_id, c_nationkey AS host_id,
   concat(CAST(CASE c_custkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 169 WHEN 4 THEN 100 ELSE 8 END AS STRING), '.',
          CAST((c_custkey * 7) % 256 AS STRING), '.', CAST((c_custkey * 13) % 256 AS STRING), '.', CAST(c_custkey % 256 AS STRING)) AS address
 FROM customer)""",
    ),
    "address_numbers": (
        ("addresses",),
        """address_numbers AS (
 SELECT *, ((CAST(split_part(address, '.', 1) AS BIGINT) * 256 + CAST(split_part(address, '.', 2) AS BIGINT)) * 256
           + CAST(split_part(address, '.', 3) AS BIGINT)) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) AS ip FROM addresses)""",
    ),
    "blocked": (
        (),
        """blocked(range, first_ip, last_ip) AS (VALUES
 ('127.0.0.0/8', 127 * 16777216, 128 * 16777216::BIGINT - 1), ('10.0.0.0/8', 10 * 16777216, 11 * 16777216 - 1),
 ('172.16.0.0/12', 172 * 16777216::BIGINT + 16 * 65536, 172 * 16777216::BIGINT + 32 * 65536 - 1),
 ('192.168.0.0/16', 192 * 16777216::BIGINT + 168 * 65536, 192 * 16777216::BIGINT + 169 * 65536 - 1),
 ('169.254.0.0/16', 169 * 16777216::BIGINT + 254 * 65536, 169 * 16777216::BIGINT + 255 * 65536 - 1),
 ('100.64.0.0/10', 100 * 16777216 + 64 * 65536, 100 * 16777216 + 128 * 65536 - 1), ('0.0.0.0/8', 0, 16777215))""",
    ),
    "pixels": (
        (),
        """pixels AS (
 SELECT label::BIGINT AS asset_id, vec_id AS frame_idx, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT) AS gray
 FROM (SELECT label, vec_id, unnest(embedding) AS x FROM embeddings))""",
    ),
    "features": (
        ("pixels",),
        """features AS (
 SELECT asset_id, frame_idx, least((sum(gray * gray) / CAST(count(*) AS DOUBLE) - pow(sum(gray) / CAST(count(*) AS DOUBLE), 2)) / 4000, 1) AS complexity,
        count(*) AS n FROM pixels GROUP BY asset_id, frame_idx)""",
    ),
    "bins": (
        ("pixels", "features"),
        """bins AS (
 SELECT f.asset_id, f.frame_idx, b.bin, coalesce(c.n, 0) / CAST(f.n AS DOUBLE) AS share
 FROM features f CROSS JOIN (SELECT unnest(range(64)) AS bin) b
 LEFT JOIN (SELECT asset_id, frame_idx, gray // 4 AS bin, count(*) AS n FROM pixels GROUP BY ALL) c
   ON c.asset_id = f.asset_id AND c.frame_idx = f.frame_idx AND c.bin = b.bin)""",
    ),
    "changes": (
        ("bins", "features"),
        """pairs AS (
 SELECT asset_id, frame_idx, bin, share, lag(share) OVER (PARTITION BY asset_id, bin ORDER BY frame_idx) AS was FROM bins),
changes AS (
 SELECT f.asset_id, f.frame_idx, f.complexity, d.distance, coalesce(d.distance > 0.15, false) AS is_scene_change
 FROM features f JOIN (
  SELECT asset_id, frame_idx,
    CASE WHEN count(was) > 0 THEN sum(CASE WHEN share + was > 1e-10 THEN (share - was) * (share - was) / (share + was) ELSE 0 END) / 2 END AS distance
  FROM pairs GROUP BY ALL) d USING (asset_id, frame_idx))""",
    ),
    "frames": (
        ("packets",),
        """frames AS (
 SELECT asset_id, packet_idx AS frame_idx, size_bytes / CAST(40007 AS DOUBLE) AS complexity,
        size_bytes % 23 = 0 AS is_scene_change, contains(flags, 'K') AS is_key FROM packets)""",
    ),
    "keyframes": (
        ("packets",),
        """keyframes AS (
 SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) - 1 AS kf_idx, frame_idx, ts FROM (
  SELECT asset_id, packet_idx AS frame_idx, pts_time AS ts FROM packets WHERE contains(flags, 'K')
  UNION ALL SELECT asset_id, 0, CAST(0 AS DOUBLE) FROM packets WHERE packet_idx = 0 AND NOT contains(flags, 'K')))""",
    ),
    "gop_ids": (
        ("packets",),
        """gop_ids AS (
 SELECT *, CAST(sum(CASE WHEN contains(flags, 'K') AND packet_idx > 0 THEN 1 ELSE 0 END)
                OVER (PARTITION BY asset_id ORDER BY packet_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop_idx FROM packets)""",
    ),
    "gops": (
        ("gop_ids",),
        """gops AS (
 SELECT *, CASE WHEN end_time - start_time > 0.001 THEN CAST(size_bytes AS DOUBLE) * 8 / (end_time - start_time)
                ELSE CAST(0 AS DOUBLE) END AS bitrate_bps FROM (
  SELECT asset_id, gop_idx, min(packet_idx) AS start_frame, max(packet_idx) AS end_frame,
         CASE WHEN gop_idx = 0 THEN CAST(0 AS DOUBLE) ELSE arg_min(pts_time, packet_idx) END AS start_time,
         arg_max(pts_time, packet_idx) AS end_time, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
  FROM gop_ids GROUP BY asset_id, gop_idx))""",
    ),
    "targets": (
        ("plain_media",),
        """targets AS (
 SELECT asset_id, CAST(2000000 AS DOUBLE) * pow(CAST(1.12 AS DOUBLE), 23 - crf) AS target_bitrate,
        codec_name <> 'h264' AS blocked FROM plain_media)""",
    ),
    "tolerances": (
        ("targets", "gops"),
        """tolerances AS (
 SELECT t.asset_id, t.target_bitrate, t.blocked,
   CASE WHEN count(g.gop_idx) = 0 THEN CAST(0.3 AS DOUBLE)
        ELSE least(greatest(2 * stddev_pop(g.bitrate_bps / t.target_bitrate) - abs(avg(g.bitrate_bps / t.target_bitrate) - 1),
                            CAST(0.05 AS DOUBLE)), CAST(0.3 AS DOUBLE)) END AS tolerance
 FROM targets t LEFT JOIN gops g USING (asset_id) GROUP BY ALL)""",
    ),
    "cuts": (
        ("keyframes", "packet_media"),
        """last_kf AS (SELECT asset_id, max(kf_idx) AS last FROM keyframes GROUP BY asset_id),
succ AS (
 SELECT k.asset_id, k.kf_idx, k.frame_idx, k.ts, m.total_frames, m.duration_secs, l.last,
   CASE WHEN k.frame_idx + 125 < m.total_frames THEN greatest(
     (SELECT n.kf_idx FROM keyframes n WHERE n.asset_id = k.asset_id
      ORDER BY abs(n.frame_idx - k.frame_idx - 125), n.frame_idx LIMIT 1), k.kf_idx + 1) END AS next
 FROM keyframes k JOIN packet_media m USING (asset_id) JOIN last_kf l USING (asset_id)),
chain AS (
 SELECT *, 0 AS step FROM succ WHERE kf_idx = 0
 UNION ALL
 SELECT s.*, c.step + 1 FROM chain c JOIN succ s ON s.asset_id = c.asset_id AND s.kf_idx = c.next WHERE c.next <= c.last),
cuts AS (
 SELECT c.asset_id, c.step::BIGINT AS segment_id, c.frame_idx AS start_frame,
        coalesce(n.frame_idx, c.total_frames) - 1 AS end_frame, c.ts AS start_ts, coalesce(n.ts, c.duration_secs) AS end_ts
 FROM chain c LEFT JOIN keyframes n ON n.asset_id = c.asset_id AND n.kf_idx = c.next
 WHERE NOT (n.kf_idx IS NULL AND c.kf_idx = c.last AND c.kf_idx > 0 AND c.total_frames - 1 <= c.frame_idx))""",
    ),
}
