"""Ingestion of documents and messages, and the output texts, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gopmill.functions.pods import pod_summary as summarize_pods
from gopmill.functions.text import source_key
from gopmill.operators import jobs, texts
from gopmill.plans import adapters, smart_report
from gopmill.plans.cluster_queries import done
from gopmill.plans.media_queries import cut, ranges, stored_gops
from gopmill.plans.registry import ORACLES, query
from gopmill.session import written
from gopmill.sources import messages, probe
from gopmill.sources.tables import list_outputs as list_files
from gopmill.sources.tables import read_parquet
from gopmill.streaming.runner import fresh_folder


# -- probe and packet documents ----------------------------------------------------------------------------


def probe_documents(spark, folder):
    """One probe document per part: a broken one, one without video, missing durations, tracks and chapters."""
    return read_parquet(spark, folder, "part").selectExpr(
        "p_partkey AS asset_id",
        """CASE WHEN p_partkey % 20 = 19 THEN '{"streams": [' WHEN p_partkey % 20 = 18 THEN '{"streams": [{"codec_type": "audio"}]}' ELSE concat(
           '{"streams": [{"index": 1, "codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000", "bit_rate": "128000",',
           ' "disposition": {"default": 1}', CASE WHEN p_partkey % 2 = 0 THEN ', "tags": {"language": "eng"}' ELSE '' END, '},',
           ' {"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1280, "height": ', CAST(700 + p_size AS STRING), ', "r_frame_rate": "',
           CASE p_partkey % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' ELSE '24' END, '"',
           CASE WHEN p_partkey % 5 = 0 THEN concat(', "duration": "', CAST(p_retailprice AS STRING), '"') ELSE '' END,
           CASE WHEN p_partkey % 7 = 0 THEN ', "nb_frames": "1234"' ELSE '' END, '},',
           ' {"index": 2, "codec_type": "subtitle", "codec_name": "', CASE WHEN p_partkey % 3 = 0 THEN 'hdmv_pgs_subtitle' ELSE 'subrip' END, '"}],',
           ' "format": {', CASE WHEN p_partkey % 5 = 1 THEN '"duration": "60.5"' ELSE '' END, '},',
           ' "chapters": [{"id": 0, "time_base": "1/1000", "start": 0, "end": ', CAST(p_partkey * 1000 AS STRING), ', "tags": {"title": "', p_name, '"}}]}') END AS json""",
    )


DURATION = "CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(60.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
RATE = "CASE p_partkey % 3 WHEN 0 THEN 30000 / CAST(1001 AS DOUBLE) WHEN 1 THEN CAST(25 AS DOUBLE) ELSE CAST(24 AS DOUBLE) END"


@query(
    "read_probe_json",
    f"""SELECT p_partkey AS asset_id, {DURATION} AS duration_secs, 1280 AS width, 700 + p_size AS height, round({RATE}, 6) AS fps,
         CASE WHEN p_partkey % 7 = 0 THEN 1234 ELSE CAST(round({DURATION} * {RATE}) AS BIGINT) END AS total_frames, 'h264' AS codec_name,
         CASE WHEN p_partkey % 2 = 0 THEN 'eng' END AS language, p_partkey % 3 <> 0 AS text_subtitle, CAST(p_partkey AS DOUBLE) AS chapter_end
       FROM part WHERE p_partkey % 20 < 18""",
)
def read_probe_json(spark, folder):
    media = probe.parse_probe(probe_documents(spark, folder))
    return media.select(
        "asset_id", "duration_secs", "width", "height", F.round("fps", 6).alias("fps"), "total_frames", "codec_name",
        F.col("audio_tracks")[0]["language"].alias("language"), F.col("subtitle_tracks")[0]["is_text_based"].alias("text_subtitle"),
        F.round(F.col("chapters")[0]["end_secs"], 6).alias("chapter_end"),
    )


@query(
    "probe_rejects",
    """SELECT p_partkey AS asset_id, CASE p_partkey % 20 WHEN 18 THEN 'No video stream found' ELSE 'No streams found' END AS reason
       FROM part WHERE p_partkey % 20 >= 18""",
)
def probe_rejects(spark, folder):
    return probe.probe_rejects(probe_documents(spark, folder)).select("asset_id", "reason")


@query(
    "read_packets_json",
    """SELECT o_orderkey AS asset_id, i AS packet_idx, CASE WHEN i = 1 THEN CAST(0 AS DOUBLE) ELSE i / CAST(2 AS DOUBLE) END AS pts_time,
         CASE WHEN i = 2 THEN 0 ELSE o_custkey END AS size_bytes, CASE WHEN i = 0 THEN 'K__' WHEN i = 2 THEN '' ELSE '__D' END AS flags
       FROM orders, unnest(range(4)) AS r(i)""",
)
def read_packets_json(spark, folder):
    """Four packets per document: a key packet, one with a bad time, one with fields missing."""
    documents = read_parquet(spark, folder, "orders").selectExpr(
        "o_orderkey AS asset_id",
        """concat('{"packets": [{"pts_time": "0.0", "size": "', CAST(o_custkey AS STRING), '", "flags": "K__"}, {"pts_time": "N/A", "size": "',
           CAST(o_custkey AS STRING), '", "flags": "__D"}, {"pts_time": "1.0"}, {"pts_time": "1.5", "size": "', CAST(o_custkey AS STRING), '", "flags": "__D"}]}') AS json""",
    )
    return probe.parse_packets(documents)


@query("read_packets_json_files", "SELECT asset_id, packet_idx, pts_time, size_bytes, flags FROM packets", ("packets",))
def read_packets_json_files(spark, folder):
    """The stored packets as one document a file, read again in as many splits as Spark makes of it."""
    packets = adapters.packets(spark, folder)
    fields = F.to_json(F.struct(F.col("pts_time").cast("string").alias("pts_time"), F.col("size_bytes").cast("string").alias("size"), "flags"))
    body = packets.select(
        "asset_id", (F.col("packet_idx") + 1).alias("line_no"), F.concat(F.when(F.col("packet_idx") > 0, ",").otherwise(""), fields).alias("line")
    )
    last = packets.groupBy("asset_id").agg((F.max("packet_idx") + 2).alias("_last"))
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit('{"packets": [').alias("line")),
        F.struct(F.col("_last").alias("line_no"), F.lit("]}").alias("line")),
    )
    path = fresh_folder(spark, "documents")
    texts.write_asset_files(body.unionByName(last.select("asset_id", F.inline(ends))), path, ".json", part_lines=2**40)
    asset = F.regexp_extract("asset_path", r"([0-9]+)[.]json$", 1).cast("bigint").alias("asset_id")
    return probe.read_packets_json(spark, path).select(asset, "packet_idx", "pts_time", "size_bytes", "flags")


# -- wire messages --------------------------------------------------------------------------------------------


def wire(spark, folder):
    """One message per event: heartbeats, progress, failures, an unknown code, broken text."""
    return read_parquet(spark, folder, "events").selectExpr(
        "event_id", "ts", "CAST(user_id AS STRING) AS peer",
        """CASE event_id % 6
           WHEN 0 THEN concat('{"op": 20, "d": {"node_id": "n', CAST(user_id AS STRING), '", "load": {"active_workers": ', CAST(event_id % 9 AS STRING), '}}}')
           WHEN 1 THEN concat('{"op": 32, "d": {"job_id": "j', CAST(user_id AS STRING), '", "completed_segments": ', CAST(event_id % 8 AS STRING),
                              ', "total_segments": ', CAST(event_id % 4 * 3 AS STRING), ', "failed_segments": 0, "phase": "processing"}}')
           WHEN 2 THEN concat('{"op": 43, "d": {"job_id": "j', CAST(user_id AS STRING), '", "segment_id": ', CAST(event_id % 12 AS STRING), ', "node_id": "n1", "error": "x"}}')
           WHEN 3 THEN '{"op": 99, "d": {}}'
           WHEN 4 THEN '{"op": 20, "d": {"node_id": "n1"}}'
           ELSE 'not json' END AS raw""",
    )


@query(
    "read_messages",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 20 WHEN 1 THEN 32 WHEN 2 THEN 43 WHEN 3 THEN 99 WHEN 4 THEN 20 END AS op,
         CASE event_id % 6 WHEN 0 THEN 'Heartbeat' WHEN 1 THEN 'JobProgress' WHEN 2 THEN 'SegmentFailed' WHEN 4 THEN 'Heartbeat' END AS op_name,
         event_id % 6 = 5 AS malformed FROM events""",
)
def read_messages(spark, folder):
    return messages.read_messages(wire(spark, folder)).select("event_id", "op", "op_name", "malformed")


@query(
    "message_payloads",
    """SELECT event_id, 'j' || user_id AS job_id, event_id % 8 AS completed_segments, event_id % 4 * 3 AS total_segments, CAST(0 AS BIGINT) AS failed_segments, 'processing' AS phase
       FROM events WHERE event_id % 6 = 1""",
)
def message_payloads(spark, folder):
    parsed = messages.read_messages(wire(spark, folder))
    return messages.payload_rows(parsed, "JobProgress").drop("ts", "peer")


# one whole message of each payload; # is the event's number, and in the field named it is read back
SAMPLES = {
    "Hello": ('{"cluster_name": "c#", "protocol_version": 1}', "cluster_name", "c"),
    "Identify": ('{"node_id": "n#", "listen_addr": "a", "capabilities": {"cpu_cores": 4}}', "node_id", "n"),
    "Identified": ('{"node_id": "n#", "cluster_nodes": [{"node_id": "m"}]}', "node_id", "n"),
    "ElectionStart": ('{"candidate_id": "n#", "priority": 18446744073709551615}', "candidate_id", "n"),
    "ElectionAlive": ('{"node_id": "n#"}', "node_id", "n"),
    "ElectionVictory": ('{"master_id": "n#"}', "master_id", "n"),
    "Heartbeat": ('{"node_id": "n#", "load": {"active_workers": 1}}', "node_id", "n"),
    "JobSubmit": ('{"job_id": "j#", "input_filename": "f", "input_size_bytes": 5, "config": {"crf": 20}}', "job_id", "j"),
    "JobAccepted": ('{"job_id": "j#", "total_segments": 3}', "job_id", "j"),
    "JobProgress": ('{"job_id": "j#", "completed_segments": 1, "total_segments": 2, "failed_segments": 0, "phase": "p"}', "job_id", "j"),
    "JobComplete": ('{"job_id": "j#", "total_segments": 2}', "job_id", "j"),
    "JobFailed": ('{"job_id": "j#", "error": "e"}', "job_id", "j"),
    "AnalyzeRequest": ('{"request_id": "r#", "source_url": "u", "encoder": "e", "crf": 1, "smart_tolerance": 0.3}', "request_id", "r"),
    "AnalyzeResult": ('{"request_id": "r#", "media": {"width": 1280}, "recommendation": {"mode": "copy"}}', "request_id", "r"),
    "SegmentAssign": ('{"job_id": "j#", "segment": {"id": 1}, "srt_url": "u", "encoding_config": {"crf": 1}}', "job_id", "j"),
    "SegmentAssignAck": ('{"job_id": "j#", "segment_id": 1, "node_id": "n"}', "job_id", "j"),
    "SegmentComplete": ('{"job_id": "j#", "result": {"segment_id": 1}, "srt_output_url": "u"}', "job_id", "j"),
    "SegmentFailed": ('{"job_id": "j#", "segment_id": 1, "node_id": "n", "error": "e"}', "job_id", "j"),
    "StatusResponse": ('{"master_id": "n#", "nodes": [], "active_jobs": [{"job_id": "j", "state": "Done"}]}', "master_id", "n"),
    "NodeLeave": ('{"node_id": "n#"}', "node_id", "n"),
    "Error": ('{"code": 7, "message": "m#"}', "message", "m"),
}
# an event in two carries a whole payload, the others an empty one
SAMPLE_SQL = ", ".join(f"({at}, '{name}', '{mark}')" for at, (name, (_, _, mark)) in enumerate(SAMPLES.items()))


def sampled(spark, folder):
    code = {name: number for number, name in messages.OPCODES.items()}
    texts_ = [[f'{{"op": {code[name]}, "d": ', body] for name, (body, _, _) in SAMPLES.items()]
    events = read_parquet(spark, folder, "events")
    which = (F.floor(F.col("event_id") / 2) % len(SAMPLES) + 1).cast("int")
    opening = F.element_at(F.array(*[F.lit(a) for a, _ in texts_]), which)
    body = F.replace(F.element_at(F.array(*[F.lit(b) for _, b in texts_]), which), F.lit("#"), F.col("event_id").cast("string"))
    whole = F.concat(opening, F.when(F.col("event_id") % 2 == 0, body).otherwise("{}"), F.lit("}"))
    return messages.read_messages(events.select("event_id", whole.alias("raw")))


@query(
    "message_payloads_all",
    f"""SELECT name AS op_name, event_id, mark || event_id AS named FROM events
        JOIN (VALUES {SAMPLE_SQL}) v(at_op, name, mark) ON event_id // 2 % {len(SAMPLES)} = at_op WHERE event_id % 2 = 0""",
)
def message_payloads_all(spark, folder):
    """Every payload type: whole messages with the field that names them, from one pass over the messages."""
    typed = messages.typed_payloads(sampled(spark, folder), list(SAMPLES))
    named = F.coalesce(*[F.col(name)[field].cast("string") for name, (_, field, _) in SAMPLES.items()])
    return typed.select("op_name", "event_id", named.alias("named"))


@query("message_rejects_all", "SELECT event_id FROM events WHERE event_id % 2 = 1")
def message_rejects_all(spark, folder):
    """Messages of every type whose payload is empty."""
    return messages.reject_rows(sampled(spark, folder)).select("event_id")


@query("message_rejects", "SELECT event_id FROM events WHERE event_id % 6 IN (4, 5)")
def message_rejects(spark, folder):
    return messages.reject_rows(messages.read_messages(wire(spark, folder))).select("event_id")


@query(
    "pod_summary",
    """SELECT 'pod-' || s_suppkey AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'Running' ELSE 'Pending' END AS phase, s_nationkey % 2 = 0 AS ready,
         CAST(s_nationkey + 2 AS BIGINT) AS restarts, CASE WHEN s_suppkey % 3 = 0 THEN 'master' ELSE 'worker' END AS role, CAST(s_suppkey % 3 AS VARCHAR) AS ordinal
       FROM supplier WHERE s_suppkey % 10 <> 9""",
)
def pod_summary(spark, folder):
    """A document per supplier; every tenth lists no pods."""
    documents = read_parquet(spark, folder, "supplier").selectExpr(
        """CASE WHEN s_suppkey % 10 = 9 THEN '{"items": null}' ELSE concat('{"items": [{"metadata": {"name": "pod-', CAST(s_suppkey AS STRING),
           '", "labels": {"apps.kubernetes.io/pod-index": "', CAST(s_suppkey % 3 AS STRING), '"}}, "status": {"phase": "',
           CASE WHEN s_nationkey % 2 = 0 THEN 'Running' ELSE 'Pending' END, '", "containerStatuses": [{"ready": ', CAST(s_nationkey % 2 = 0 AS STRING),
           ', "restartCount": ', CAST(s_nationkey AS STRING), '}, {"ready": true, "restartCount": 2}]}, "spec": {}}]}') END AS json"""
    )
    return summarize_pods(documents).select("name", "phase", "ready", "restarts", "role", "ordinal")


@query(
    "list_outputs",
    """SELECT 'asset_id=' || asset_id AS folder, CAST(1 AS BIGINT) AS files, true AS filled
       FROM (SELECT DISTINCT p_partkey % 10 AS asset_id FROM part)""",
)
def list_outputs(spark, folder):
    """The listing of a table written here in a known layout: one file for each asset's folder."""
    parts = read_parquet(spark, folder, "part").select((F.col("p_partkey") % 10).alias("asset_id"), "p_name")
    path = fresh_folder(spark, "outputs")
    parts.repartition("asset_id").write.partitionBy("asset_id").parquet(path)
    listed = list_files(spark, path).where(F.col("name").endswith(".parquet"))
    where = F.regexp_extract("path", "(asset_id=[0-9]+)/", 1).alias("folder")
    return listed.groupBy(where).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("size") > 0).alias("filled"))


@query(
    "read_parquet",
    "SELECT * FROM lineitem",
)
def read_parquet_table(spark, folder):
    return read_parquet(spark, folder, "lineitem")


# -- output texts ------------------------------------------------------------------------------------------------


def cut_and_results(spark, folder):
    """Segments, a result for two of three of them, and one for a segment that does not exist."""
    segments = written(cut(spark, folder))
    made = segments.select("asset_id", "segment_id").where(F.col("segment_id") % 3 != 1)
    extra = adapters.packet_media(spark, folder).select("asset_id", F.lit(5000).cast("bigint").alias("segment_id"))
    name = F.concat(F.lit("/out/"), F.format_string("segment_%04d.ts", F.col("segment_id")))
    return segments, made.unionByName(extra).withColumn("output_path", name)


adapters.CTES["results"] = (
    ("cuts",),
    """results AS (
 SELECT r.*, printf('segment_%04d.ts', r.segment_id) AS name, coalesce(c.end_ts - c.start_ts, 0) AS duration FROM (
  SELECT asset_id, segment_id FROM cuts WHERE segment_id % 3 <> 1 UNION ALL SELECT asset_id, 5000 FROM packet_media) r
 LEFT JOIN cuts c USING (asset_id, segment_id))""",
)


@query(
    "results_with_segments",
    "SELECT asset_id, segment_id, round(duration, 6) AS duration FROM results",
    ("results",),
)
def results_with_segments(spark, folder):
    segments, results = cut_and_results(spark, folder)
    joined = jobs.results_with_segments(results, segments)
    return joined.select("asset_id", "segment_id", F.round("duration", 6).alias("duration"))


@query(
    "hls_playlist",
    """SELECT * FROM (WITH longest AS (SELECT asset_id, CAST(ceil(max(end_ts - start_ts)) AS BIGINT) AS longest FROM cuts GROUP BY asset_id),
       ends AS (SELECT asset_id, max(segment_id) AS last FROM results GROUP BY asset_id)
       SELECT asset_id, 4 + 2 * segment_id AS line_no, '#EXTINF:' || printf('%.6f', duration) || ',' AS line FROM results
       UNION ALL SELECT asset_id, 5 + 2 * segment_id, name FROM results
       UNION ALL SELECT asset_id, 0, '#EXTM3U' FROM ends UNION ALL SELECT asset_id, 1, '#EXT-X-VERSION:3' FROM ends
       UNION ALL SELECT asset_id, 2, '#EXT-X-TARGETDURATION:' || longest FROM ends JOIN longest USING (asset_id)
       UNION ALL SELECT asset_id, 3, '#EXT-X-MEDIA-SEQUENCE:0' FROM ends UNION ALL SELECT asset_id, 6 + 2 * last, '#EXT-X-ENDLIST' FROM ends)""",
    ("results",),
)
def hls_playlist(spark, folder):
    segments, results = cut_and_results(spark, folder)
    return texts.hls_playlist(results, segments)


@query(
    "hls_playlist_files",
    """SELECT name, octet_length(encode(text)) AS size, sha256(text) AS digest FROM (
         SELECT asset_id || '.m3u8' AS name, string_agg(line || chr(10), '' ORDER BY line_no) AS text FROM (
           WITH longest AS (SELECT asset_id, CAST(ceil(max(end_ts - start_ts)) AS BIGINT) AS longest FROM cuts GROUP BY asset_id),
           ends AS (SELECT asset_id, max(segment_id) AS last FROM results GROUP BY asset_id)
           SELECT asset_id, 4 + 2 * segment_id AS line_no, '#EXTINF:' || printf('%.6f', duration) || ',' AS line FROM results
           UNION ALL SELECT asset_id, 5 + 2 * segment_id, name FROM results
           UNION ALL SELECT asset_id, 0, '#EXTM3U' FROM ends UNION ALL SELECT asset_id, 1, '#EXT-X-VERSION:3' FROM ends
           UNION ALL SELECT asset_id, 2, '#EXT-X-TARGETDURATION:' || longest FROM ends JOIN longest USING (asset_id)
           UNION ALL SELECT asset_id, 3, '#EXT-X-MEDIA-SEQUENCE:0' FROM ends UNION ALL SELECT asset_id, 6 + 2 * last, '#EXT-X-ENDLIST' FROM ends)
         GROUP BY asset_id)""",
    ("results",),
)
def hls_playlist_files(spark, folder):
    """A file for each asset's playlist, as it stands in the store."""
    segments, results = cut_and_results(spark, folder)
    path = fresh_folder(spark, "playlists")
    texts.write_asset_files(texts.hls_playlist(results, segments), path, ".m3u8")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


@query(
    "concat_list",
    "SELECT asset_id, segment_id AS line_no, 'file ''' || name || '''' AS line FROM results",
    ("results",),
)
def concat_list(spark, folder):
    return texts.concat_list(cut_and_results(spark, folder)[1])


@query(
    "hls_master",
    """SELECT p_partkey AS asset_id, concat('#EXTM3U', chr(10), '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",LANGUAGE="',
         CASE WHEN p_partkey % 2 = 0 THEN 'eng' ELSE 'und' END, '",NAME="', CASE WHEN p_partkey % 2 = 0 THEN 'eng' ELSE 'Default' END, '",DEFAULT=YES,AUTOSELECT=YES', chr(10),
         CASE WHEN p_partkey % 3 <> 0 THEN concat('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",LANGUAGE="und",NAME="und",DEFAULT=NO,AUTOSELECT=YES,URI="subs_und.vtt"', chr(10)) ELSE '' END,
         '#EXT-X-STREAM-INF:BANDWIDTH=0,AUDIO="audio"', CASE WHEN p_partkey % 3 <> 0 THEN ',SUBTITLES="subs"' ELSE '' END, chr(10), 'video.m3u8', chr(10)) AS text
       FROM part WHERE p_partkey % 20 < 18""",
)
def hls_master(spark, folder):
    return texts.hls_master(probe.parse_probe(probe_documents(spark, folder)))


@query(
    "chapter_metadata",
    """SELECT p_partkey AS asset_id, concat(';FFMETADATA1', chr(10), '[CHAPTER]', chr(10), 'TIMEBASE=1/1000', chr(10), 'START=0', chr(10), 'END=', p_partkey * 1000, chr(10),
         'title=', p_name, chr(10)) AS text FROM part WHERE p_partkey % 20 < 18""",
)
def chapter_metadata(spark, folder):
    return texts.chapter_metadata(probe.parse_probe(probe_documents(spark, folder)))


@query(
    "object_keys",
    """SELECT job_id, segment_id, 'jobs/' || job_id || '/input/seg_' || segment_id || '.ts' AS input_key,
         'jobs/' || job_id || '/output/seg_' || segment_id || '.ts' AS output_key, 'jobs/' || job_id || '/final/output.mp4' AS final_key,
         printf('segment_%04d.ts', segment_id) AS file_name FROM segments""",
    ("segments",),
)
def object_keys(spark, folder):
    return texts.object_keys(adapters.segments(spark, folder))


@query(
    "ordered_results",
    "SELECT job_id, segment_id, frames_encoded FROM done ORDER BY job_id, segment_id",
    ("done",),
)
def ordered_results(spark, folder):
    return jobs.ordered_results(done(spark, folder)).select("job_id", "segment_id", "frames_encoded")


COPY_RULE = "NOT blocked AND coalesce(ratio BETWEEN 1 - CAST(0.3 AS DOUBLE) AND 1 + CAST(0.3 AS DOUBLE), false)"
# every segment with its decision, ratio and reasons, and the counts of the asset
REPORT_SQL = """SELECT asset_id, segment_id, CASE WHEN {rule} THEN 'copy' ELSE 'encode' END AS decision, round(ratio, 6) AS ratio,
         concat_ws('; ', CASE WHEN blocked THEN 'source codec hevc differs from target h264' END,
           CASE WHEN ratio IS NULL THEN 'no GOP data' WHEN NOT ratio BETWEEN 1 - CAST(0.3 AS DOUBLE) AND 1 + CAST(0.3 AS DOUBLE)
                THEN 'bitrate ratio ' || printf('%.2f', ratio) || ' outside ±30%' END) AS reasons, CAST(NULL AS BIGINT) AS copies FROM {plan}
       UNION ALL SELECT asset_id, NULL, NULL, NULL, CASE WHEN blocked THEN 'source codec hevc differs from target h264' ELSE '' END,
         count(*) FILTER ({rule}) FROM {plan} GROUP BY asset_id, blocked"""


def _reports(spark, folder):
    return smart_report.smart_reports(adapters.plain_media(spark, folder), stored_gops(spark, folder), ranges(spark, folder), 0.3)


@query("smart_report", REPORT_SQL.format(rule=COPY_RULE, plan="plan"), ("plan",))
def smart_report_query(spark, folder):
    """The JSON rows of every asset with packets, read back; media and advice are compared in smart_report_heads."""
    return _read_back(_reports(spark, folder))


def _read_back(reports):
    schema = "decision string, bitrate_ratio double, reasons array<string>, summary struct<copy_segments bigint, global_blockers array<string>>"
    read = reports.select("asset_id", "segment_id", F.from_json("text", schema).alias("r"))
    return read.select(
        "asset_id", "segment_id", F.col("r.decision").alias("decision"), F.round("r.bitrate_ratio", 6).alias("ratio"),
        F.array_join(F.coalesce("r.reasons", "r.summary.global_blockers"), "; ").alias("reasons"), F.col("r.summary.copy_segments").alias("copies"),
    )


@query(
    "smart_report_heads",
    f"""SELECT m.*, s.total_segments, s.encode_segments, r.mode, r.preset, r.reason, r.preset_reason, r.copyable_gop_fraction
        FROM (SELECT m.asset_id, duration_secs, width, height, fps, codec_name AS codec, profile, pix_fmt, round(avg(bitrate_bps), 3) AS avg_bitrate_bps
              FROM plain_media m LEFT JOIN gops g USING (asset_id) GROUP BY ALL) m
        JOIN ({ORACLES['report_summary']}) s USING (asset_id) JOIN ({ORACLES['recommend']}) r USING (asset_id)""",
    ("plain_media", "gops"),
)
def smart_report_heads(spark, folder):
    """The JSON row of each asset, read back: media, counts and recommendation."""
    schema = (
        "summary struct<total_segments bigint, encode_segments bigint>, media struct<duration_secs double, width int, height int, fps double, codec string, "
        "profile string, pix_fmt string, avg_bitrate_bps double>, recommendation struct<mode string, preset string, reasons array<string>, copyable_gop_fraction double>"
    )
    read = _reports(spark, folder).where("segment_id is null").select("asset_id", F.from_json("text", schema).alias("r"))
    flat = read.select("asset_id", "r.media.*", "r.summary.*", "r.recommendation.*")
    return flat.withColumns({
        "avg_bitrate_bps": F.round("avg_bitrate_bps", 3), "copyable_gop_fraction": F.round("copyable_gop_fraction", 6),
        "reason": F.col("reasons")[0], "preset_reason": F.col("reasons")[1],
    }).drop("reasons")


adapters.CTES["cut_plan"] = (
    ("cuts", "gops", "tolerances"),
    """cut_plan AS (
 SELECT r.asset_id, r.segment_id, t.blocked, avg(g.bitrate_bps) / t.target_bitrate AS ratio
 FROM cuts r JOIN tolerances t USING (asset_id)
 LEFT JOIN gops g ON g.asset_id = r.asset_id AND g.start_time < r.end_ts AND g.end_time > r.start_ts
 GROUP BY r.asset_id, r.segment_id, t.target_bitrate, t.blocked)""",
)


@query("analyze", REPORT_SQL.format(rule=COPY_RULE, plan="cut_plan"), ("cut_plan",))
def analyze(spark, folder):
    """From packets to reports: keyframes, GOPs, keyframe-aligned segments, plan, texts."""
    lengths = adapters.packet_media(spark, folder).drop("fps")
    media = adapters.plain_media(spark, folder).drop("duration_secs").join(lengths, "asset_id")
    return _read_back(smart_report.analyze(media, adapters.packets(spark, folder), adapters.TARGET_SECS, 0.3))


@query(
    "track_keys",
    """SELECT p_partkey AS asset_id, 'sources/' || p_name || '.mp4' AS source_key, CASE WHEN p_partkey % 3 <> 0 THEN 'subs_und.vtt' END AS subtitle_file
       FROM part WHERE p_partkey % 20 < 18""",
)
def track_keys(spark, folder):
    """Object key of each source and the file of its text subtitles."""
    media = probe.parse_probe(probe_documents(spark, folder))
    name = F.concat(F.lit("up/"), F.col("chapters")[0]["title"], F.lit(".mp4"))
    return media.select(
        "asset_id", source_key(name).alias("source_key"), F.get(texts.subtitle_files(F.col("subtitle_tracks")), F.lit(0))["file"].alias("subtitle_file")
    )
