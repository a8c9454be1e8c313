"""Streaming operators run over the given tables as streams; each is checked against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gopmill.plans import adapters
from gopmill.plans.registry import query
from gopmill.plans.scalar_queries import VALIDATE_SQL, _rules, request_columns
from gopmill.sources import messages
from gopmill.streaming import runner, streams

HALF_DAY = 12 * 3600
# Longer than the events span, so that no key is forgotten between them.
YEAR = 366 * 86400


@query(
    "request_rate",
    """SELECT user_id AS client_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS requests, count(*) > 2 AS limited
       FROM events GROUP BY ALL""",
)
def request_rate(spark, folder):
    """Six-hour windows and a limit of two, because the events lie hours apart; complete, so run to its end."""
    calls = runner.stream_table(spark, folder, "events").select(F.col("user_id").alias("client_id"), "ts")
    rated = runner.run_available(streams.request_rate(calls, 2, "6 hours", "0 seconds"), "update")
    latest = rated.groupBy("client_id", "window_start").agg(F.max(F.struct("requests", "limited")).alias("r"))
    return latest.select("client_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "r.requests", "r.limited")


def _status_changes(spark, folder):
    beats = runner.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("node_id"), "ts", (F.floor("value").cast("int") % 9).alias("active_workers")
    )
    registry = adapters.heartbeats(spark, folder).select("node_id").distinct().select(
        "node_id", F.lit(8).alias("max_concurrent_workers"), F.lit("Active").alias("status")
    )
    return runner.run_available(streams.node_liveness_stream(beats, registry, HALF_DAY, "0 seconds"))


@query(
    "node_liveness_stream",
    """SELECT node_id, "at", status FROM (
         WITH given AS (SELECT node_id, date_trunc('millisecond', ts) AS ts, active_workers, max(date_trunc('millisecond', ts)) OVER () AS judged FROM heartbeats),
         live AS (SELECT DISTINCT node_id, judged, TIMESTAMP '2024-01-01' + to_hours(CAST(node_id % 500 AS INT)) AS since FROM given),
         all_nodes AS (SELECT * FROM live UNION ALL SELECT node_id + 1000000, judged, TIMESTAMP '2024-01-01' + to_hours(CAST((node_id + 1000000) % 500 AS INT)) FROM live),
         signs AS (SELECT *, lead(ts) OVER w AS back_at, lag(ts) OVER w AS before, lag(active_workers) OVER w AS was FROM (
             SELECT g.node_id, g.ts, g.active_workers, g.judged FROM given g JOIN all_nodes a ON a.node_id = g.node_id AND g.ts >= a.since
             UNION ALL SELECT node_id, since, -1, judged FROM all_nodes) WINDOW w AS (PARTITION BY node_id ORDER BY ts, active_workers))
         SELECT node_id, ts + INTERVAL 12 HOUR AS "at", 'Dead' AS status FROM signs WHERE coalesce(back_at, judged) - ts > INTERVAL 12 HOUR
         UNION ALL
         SELECT node_id, ts, CASE WHEN active_workers >= 8 THEN 'Busy' ELSE 'Active' END FROM (SELECT *, ts - before > INTERVAL 12 HOUR AS gap FROM signs)
         WHERE active_workers >= 0 AND CASE WHEN active_workers >= 8 THEN was < 8 OR gap ELSE was >= 8 OR gap END)""",
    ("heartbeats",),
)
def node_liveness_stream(spark, folder):
    """Every transition; the clock of a node starts with its registration, and half of the registered nodes never beat."""
    beats = runner.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("node_id"), "ts", (F.floor("value").cast("int") % 9).alias("active_workers")
    )
    live = adapters.heartbeats(spark, folder).select("node_id").distinct()
    since = F.timestamp_add("HOUR", F.pmod("node_id", F.lit(500)).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    registry = live.unionByName(live.select((F.col("node_id") + 1_000_000).alias("node_id"))).select(
        "node_id", F.lit(8).alias("max_concurrent_workers"), F.lit("Active").alias("status"), since.alias("registered_at")
    )
    changes = runner.run_available(streams.node_liveness_stream(beats, registry, HALF_DAY, "0 seconds"))
    return changes.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "node_status_changes_stream",
    """SELECT node_id, ts + INTERVAL 12 HOUR AS at, 'Dead' AS status FROM (
         SELECT node_id, date_trunc('millisecond', ts) AS ts, lead(date_trunc('millisecond', ts)) OVER (PARTITION BY node_id ORDER BY ts) AS back_at FROM heartbeats)
       WHERE coalesce(back_at, (SELECT max(date_trunc('millisecond', ts)) FROM heartbeats)) - ts > INTERVAL 12 HOUR
       UNION ALL
       SELECT node_id, date_trunc('millisecond', ts), CASE WHEN active_workers >= 8 THEN 'Busy' ELSE 'Active' END FROM (
         SELECT *, lag(active_workers) OVER w AS was, date_trunc('millisecond', ts) - date_trunc('millisecond', lag(ts) OVER w) > INTERVAL 12 HOUR AS gap FROM heartbeats WINDOW w AS (PARTITION BY node_id ORDER BY ts))
       WHERE CASE WHEN active_workers >= 8 THEN was IS NULL OR was < 8 OR gap ELSE was >= 8 OR gap END""",
    ("heartbeats",),
)
def node_status_changes_stream(spark, folder):
    """Every transition with its time, those to Active too."""
    return _status_changes(spark, folder).withColumn("at", F.col("at").cast("timestamp_ntz"))


adapters.CTES["eprogress"] = (
    (),
    """elatest AS (
 SELECT user_id AS job_id, event_id % 12 AS segment_id, arg_max(CASE WHEN event_type IN ('click', 'purchase') THEN 'complete'
   WHEN event_type = 'error' THEN 'failed' ELSE 'assign' END, event_id) AS kind FROM events GROUP BY ALL),
eprogress AS (
 SELECT job_id, CAST(12 AS BIGINT) AS total, count(*) FILTER (kind = 'complete') AS completed, count(*) FILTER (kind = 'failed') AS failed,
        count(*) FILTER (kind = 'assign') AS assigned, 12 - count(*) AS pending FROM elatest GROUP BY job_id)""",
)


@query("job_progress_stream", "SELECT job_id, total, completed, failed, assigned, pending FROM eprogress", ("eprogress",))
def job_progress_stream(spark, folder):
    """Users as jobs, twelve segments each, ordered by event_id."""
    kind = F.expr("CASE WHEN event_type IN ('click', 'purchase') THEN 'complete' WHEN event_type = 'error' THEN 'failed' ELSE 'assign' END")
    reports = runner.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 12).alias("segment_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts"
    )
    totals = adapters.heartbeats(spark, folder).select(F.col("node_id").alias("job_id")).distinct().withColumn("total", F.lit(12).cast("bigint"))
    updates = runner.run_available(streams.job_progress_stream(reports, shards=4, keep_secs=YEAR), "update")
    return streams.job_progress_totals(updates, totals)


@query("log_phase_stream", "SELECT * FROM phases", ("phases",))
def log_phase_stream(spark, folder):
    lines = adapters.log_lines_of(runner.stream_table(spark, folder, "events"))
    return runner.run_available(streams.log_phase_stream(lines, "0 seconds", keep_secs=YEAR))


@query(
    "progress_percent_stream",
    """SELECT event_id AS seq, 'j' || user_id AS job_id, completed_segments, total_segments,
         CAST(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS percent FROM (
         SELECT *, CASE WHEN total_segments > 0 THEN round(completed_segments / CAST(total_segments AS DOUBLE) * 100) END AS own FROM (
           SELECT user_id, event_id, event_id % 8 AS completed_segments, event_id % 4 * 3 AS total_segments FROM events))""",
)
def progress_percent_stream(spark, folder):
    """One progress message per event."""
    raw = runner.stream_table(spark, folder, "events").selectExpr(
        "event_id AS seq", "ts",
        """concat('{"op": 32, "d": {"job_id": "j', CAST(user_id AS STRING), '", "completed_segments": ', CAST(event_id % 8 AS STRING),
           ', "total_segments": ', CAST(event_id % 4 * 3 AS STRING), ', "failed_segments": 0, "phase": "processing"}}') AS raw""",
    )
    return runner.run_available(streams.progress_percent_stream(messages.read_messages(raw), "0 seconds", keep_secs=YEAR))


@query(
    "grant_redemption_stream",
    """SELECT user_id AS ticket, event_id AS attempt_id,
         CAST(coalesce(event_id = min(CASE WHEN ok THEN event_id END) OVER (PARTITION BY user_id), false) AS BOOLEAN) AS redeemed
       FROM (SELECT a.user_id, a.event_id, a.event_type = g.event_type AND a.ts - g.ts < INTERVAL 6 DAY AS ok
             FROM (SELECT user_id, event_id, event_type, date_trunc('millisecond', ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) a
             JOIN (SELECT user_id, event_type, date_trunc('millisecond', ts) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) g USING (user_id)
             WHERE a.n > 1)""",
)
def grant_redemption_stream(spark, folder):
    """A user's first event grants, the later ones try; the event type is the file. Six days to live."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    stream = runner.stream_table(spark, folder, "events").join(firsts, "user_id")
    columns = [F.col("user_id").alias("ticket"), F.lit("job").alias("job_id"), F.col("event_type").alias("filename")]
    grants = stream.where(F.col("event_id") == F.col("first_id")).select(*columns, F.col("ts").alias("issued_at"))
    tries = stream.where(F.col("event_id") > F.col("first_id")).select(*columns, F.col("event_id").alias("attempt_id"), "ts")
    return runner.run_available(streams.grant_redemption_stream(grants, tries, 6 * 86400, "0 seconds"))


def _replayed_gops(spark, packets, keep_secs=YEAR):
    base = runner.fresh_folder(spark)
    packets.write.mode("overwrite").parquet(base)
    replay = spark.readStream.schema(spark.read.parquet(base).schema).parquet(base)
    timed = replay.withColumn("ts", F.timestamp_millis((F.col("pts_time") * 1000).cast("bigint") + 1_700_000_000_000))
    return runner.run_available(streams.live_gop_stats(timed, "0 seconds", keep_secs)).withColumn("bitrate_bps", F.round("bitrate_bps", 3))


GOPS_SQL = "SELECT asset_id, gop_idx, start_frame, end_frame, start_time, end_time, size_bytes, round(bitrate_bps, 3) AS bitrate_bps FROM gops"


@query("live_gop_stats", GOPS_SQL, ("gops",))
def live_gop_stats(spark, folder):
    """The stored packets replayed without end rows; a silence of an hour closes each asset's last GOP."""
    packets = adapters.packets(spark, folder).select("asset_id", "packet_idx", "pts_time", "size_bytes", "flags")
    clock = packets.agg(F.lit(-1).cast("bigint").alias("asset_id"), F.lit(0).cast("bigint").alias("packet_idx"), (F.max("pts_time") + 7200).alias("pts_time"))
    later = clock.withColumn("size_bytes", F.lit(0).cast("bigint")).withColumn("flags", F.lit("___"))
    return _replayed_gops(spark, packets.unionByName(later).withColumn("is_end", F.lit(False)), 3600).where(F.col("asset_id") >= 0)


@query(
    "live_gop_stats_ended",
    GOPS_SQL,
    ("gops",),
)
def live_gop_stats_ended(spark, folder):
    """The same replay with an end row after each asset's last packet, so every GOP closes; a later row moves the watermark."""
    packets = adapters.packets(spark, folder).select("asset_id", "packet_idx", "pts_time", "size_bytes", "flags").withColumn("is_end", F.lit(False))
    last = packets.groupBy("asset_id").agg((F.max("packet_idx") + 1).alias("packet_idx"), (F.max("pts_time") + 1).alias("pts_time"))
    ends = last.withColumn("is_end", F.lit(True))
    clock = last.agg(F.lit(-1).cast("bigint").alias("asset_id"), F.lit(0).cast("bigint").alias("packet_idx"), (F.max("pts_time") + 3600).alias("pts_time"))
    extra = ends.unionByName(clock.withColumn("is_end", F.lit(False)))
    extra = extra.withColumn("size_bytes", F.lit(0).cast("bigint")).withColumn("flags", F.lit("___"))
    return _replayed_gops(spark, packets.unionByName(extra))


@query("request_validation_stream", VALIDATE_SQL.format(_rules(False)), ("requests",))
def request_validation_stream(spark, folder):
    """Both outputs of the split, put together again."""
    runner.use_rocksdb(spark)
    stream = adapters.requests_of(runner.stream_table(spark, folder, "orders"))
    base = runner.fresh_folder(spark)
    write = streams.split_requests(request_columns(), f"{base}/valid", f"{base}/rejected", max_workers=8)
    runner.drain(stream.writeStream.foreachBatch(write), base)
    valid = spark.read.parquet(f"{base}/valid").select("request_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("error"))
    return valid.unionByName(spark.read.parquet(f"{base}/rejected").select("request_id", "field", "error"))


@query(
    "node_membership_stream",
    """SELECT 'n' || user_id AS node_id, arg_max(event_type <> 'error', (ts, event_type = 'error')) AS joined,
         CASE WHEN arg_max(event_type <> 'error', ts) THEN 'h' || arg_max(event_id, ts) END AS address,
         CASE WHEN arg_max(event_type <> 'error', ts) THEN 'Active' END AS status FROM events GROUP BY user_id""",
)
def node_membership_stream(spark, folder):
    """Errors as departures, every other event as an Identify."""
    raw = runner.stream_table(spark, folder, "events").selectExpr(
        "ts",
        """CASE WHEN event_type = 'error' THEN concat('{"op": 70, "d": {"node_id": "n', CAST(user_id AS STRING), '"}}')
           ELSE concat('{"op": 1, "d": {"node_id": "n', CAST(user_id AS STRING), '", "listen_addr": "h', CAST(event_id AS STRING),
                '", "capabilities": {"cpu_cores": 8, "max_concurrent_workers": 4}, "event_subscriptions": 0}}') END AS raw""",
    )
    roster = runner.run_available(streams.node_membership_stream(messages.read_messages(raw)), "update")
    facts = F.max(F.struct("ts", "joined", "address", "status")).alias("m")
    return roster.groupBy("node_id").agg(facts).select("node_id", "m.joined", "m.address", "m.status")


@query(
    "ingest_sources_once_stream",
    "SELECT DISTINCT user_id AS upload_id, true AS ok FROM events WHERE event_type <> 'error'",
)
def ingest_sources_once_stream(spark, folder):
    tries = runner.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("upload_id"), (F.col("event_type") != "error").alias("ok"), "ts"
    )
    return runner.run_available(streams.ingest_sources_once_stream(tries, keep_secs=YEAR)).select("upload_id", "ok")
