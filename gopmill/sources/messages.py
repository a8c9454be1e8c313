"""Wire messages ``{"op": number, "d": object}`` to typed rows, batch or stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes of the wire format.
OPCODES = {
    0: "Hello", 1: "Identify", 2: "Identified",
    10: "ElectionStart", 11: "ElectionAlive", 12: "ElectionVictory",
    20: "Heartbeat", 21: "HeartbeatAck",
    30: "JobSubmit", 31: "JobAccepted", 32: "JobProgress", 33: "JobComplete", 34: "JobFailed", 35: "JobCancel",
    36: "AnalyzeRequest", 37: "AnalyzeResult",
    40: "SegmentAssign", 41: "SegmentAssignAck", 42: "SegmentComplete", 43: "SegmentFailed",
    50: "StatusRequest", 51: "StatusResponse",
    60: "Event", 70: "NodeLeave", 255: "Error",
}
CAPABILITIES = (
    "struct<cpu_cores: bigint, available_memory_mb: bigint, has_gpu: boolean, gpu_encoder: string, hostname: string, "
    "os: string, max_concurrent_workers: bigint>"
)
LOAD = (
    "struct<active_workers: bigint, cpu_usage_percent: double, memory_used_mb: bigint, segments_completed: bigint, "
    "segments_failed: bigint>"
)
CONFIG = (
    "struct<crf: int, preset: string, encoder: string, format: string, fast_mode: boolean, hw_decode: boolean, "
    "mode: string, smart_tolerance: double>"
)
NODE = (
    f"struct<node_id: string, address: string, capabilities: {CAPABILITIES}, load: {LOAD}, is_master: boolean, "
    "last_heartbeat_ms: bigint, status: string>"
)
SEGMENT = (
    "struct<id: bigint, start_frame: bigint, end_frame: bigint, start_timestamp: double, end_timestamp: double, "
    "lookahead_frames: bigint, complexity_estimate: double, scene_changes: array<bigint>, copy: boolean>"
)
RESULT = (
    "struct<segment_id: bigint, worker_id: bigint, node_id: string, frames_encoded: bigint, output_size_bytes: bigint, "
    "encoding_time_secs: double, average_complexity: double, scene_changes_detected: bigint>"
)
MEDIA = (
    "struct<duration_secs: double, width: bigint, height: bigint, fps: double, codec: string, profile: string, pix_fmt: string, "
    "avg_bitrate_bps: double, has_audio: boolean>"
)
ADVICE = "struct<mode: string, preset: string, reasons: array<string>, copyable_gop_fraction: double>"
JOB = (
    "struct<job_id: string, state: string, total_segments: bigint, completed_segments: bigint, failed_segments: bigint, "
    "assigned_nodes: array<string>>"
)
PAYLOADS = {
    "Hello": "cluster_name string, protocol_version bigint, master_id string",
    "Identify": f"node_id string, listen_addr string, capabilities {CAPABILITIES}, event_subscriptions bigint",
    "Identified": f"node_id string, master_id string, cluster_nodes array<{NODE}>",
    "ElectionStart": "candidate_id string, priority decimal(20,0)",
    "ElectionAlive": "node_id string",
    "ElectionVictory": "master_id string",
    "Heartbeat": f"node_id string, load {LOAD}",
    "JobSubmit": (
        f"job_id string, input_filename string, input_size_bytes bigint, config {CONFIG}, srt_input_url string"
    ),
    "JobAccepted": "job_id string, total_segments bigint",
    "JobProgress": (
        "job_id string, completed_segments bigint, total_segments bigint, failed_segments bigint, phase string"
    ),
    "JobComplete": "job_id string, total_segments bigint, output_uri string",
    "JobFailed": "job_id string, error string",
    "AnalyzeRequest": "request_id string, source_url string, encoder string, crf int, smart_tolerance double",
    "AnalyzeResult": f"request_id string, media {MEDIA}, recommendation {ADVICE}",
    "SegmentAssign": f"job_id string, segment {SEGMENT}, srt_url string, encoding_config {CONFIG}",
    "SegmentAssignAck": "job_id string, segment_id bigint, node_id string",
    "SegmentComplete": f"job_id string, result {RESULT}, srt_output_url string",
    "SegmentFailed": "job_id string, segment_id bigint, node_id string, error string",
    "StatusResponse": f"master_id string, nodes array<{NODE}>, active_jobs array<{JOB}>",
    "NodeLeave": "node_id string",
    "Error": "code bigint, message string",
}
# Fields a payload cannot do without; one missing makes the message malformed.
REQUIRED = {
    "Hello": ("cluster_name", "protocol_version"),
    "ElectionStart": ("candidate_id", "priority"),
    "ElectionAlive": ("node_id",),
    "ElectionVictory": ("master_id",),
    "JobAccepted": ("job_id", "total_segments"),
    "JobComplete": ("job_id", "total_segments"),
    "JobFailed": ("job_id", "error"),
    "AnalyzeResult": ("request_id", "media", "recommendation"),
    "SegmentAssignAck": ("job_id", "segment_id", "node_id"),
    "StatusResponse": ("nodes", "active_jobs"),
    "Error": ("code", "message"),
    "Identify": ("node_id", "listen_addr", "capabilities"),
    "Identified": ("node_id", "cluster_nodes"),
    "Heartbeat": ("node_id", "load"),
    "JobSubmit": ("job_id", "input_filename", "input_size_bytes", "config"),
    "JobProgress": ("job_id", "completed_segments", "total_segments", "failed_segments", "phase"),
    "AnalyzeRequest": ("request_id", "source_url", "encoder", "crf", "smart_tolerance"),
    "SegmentAssign": ("job_id", "segment", "srt_url", "encoding_config"),
    "SegmentComplete": ("job_id", "result", "srt_output_url"),
    "SegmentFailed": ("job_id", "segment_id", "node_id", "error"),
    "NodeLeave": ("node_id",),
}
DEFAULT_MODE, DEFAULT_TOLERANCE = "normal", 0.3


def _op_name(op: Column) -> Column:
    name = F.lit(None).cast("string")
    for code, text in OPCODES.items():
        name = F.when(op == code, text).otherwise(name)
    return name


def read_messages(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Messages with ``op``, ``op_name`` (null for an unknown code), payload text ``d`` and ``malformed``.

    A message is malformed when it is no object with a number ``op`` and a ``d``. Rows are kept either
    way, so nothing is dropped silently; works on a table or a stream.
    """
    parsed = F.from_json(F.col(text), "op int, d string")
    bad = parsed.isNull() | parsed["op"].isNull() | parsed["d"].isNull()
    return raw.withColumns(
        {"op": parsed["op"], "op_name": _op_name(parsed["op"]), "d": parsed["d"], "malformed": bad}
    )


def _with_defaults(config: Column) -> Column:
    return F.when(
        config.isNotNull(),
        config.withField("mode", F.coalesce(config["mode"], F.lit(DEFAULT_MODE))).withField(
            "smart_tolerance", F.coalesce(config["smart_tolerance"], F.lit(DEFAULT_TOLERANCE))
        ),
    )


def _whole(payload: Column, name: str) -> Column:
    whole = payload.isNotNull()
    for field in REQUIRED.get(name, ()):
        whole = whole & payload[field].isNotNull()
    return whole


def _filled(payload: Column, name: str) -> Column:
    """A payload with the defaults of the fields that have some."""
    fields = T.StructType.fromDDL(PAYLOADS[name]).fieldNames()
    for field in ("config", "encoding_config"):
        if field in fields:
            payload = payload.withField(field, _with_defaults(payload[field]))
    if "segment" in fields:
        segment = payload["segment"]
        payload = payload.withField("segment", segment.withField("copy", F.coalesce(segment["copy"], F.lit(False))))
    return payload


def _kept(messages: DataFrame) -> list[str]:
    return [c for c in messages.columns if c not in ("raw", "op", "op_name", "d", "malformed")]


def payload_rows(messages: DataFrame, name: str) -> DataFrame:
    """Typed rows of one operation, with the columns of ``messages`` other than the parsed ones in front."""
    rows = messages.where((F.col("op_name") == name) & ~F.col("malformed")).withColumn("_p", F.from_json("d", PAYLOADS[name]))
    return rows.where(_whole(F.col("_p"), name)).withColumn("_p", _filled(F.col("_p"), name)).select(*_kept(messages), "_p.*")


def typed_payloads(messages: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Whole messages of all operations in one pass: ``op_name``, and under each operation's name its payload, else null.

    A message is parsed once, as its own type. Written as Parquet, ``op_name`` as partitions, it serves readers of one
    operation: ``where(op_name = ...).select("JobSubmit.*")`` reads that column alone.
    """
    names = list(PAYLOADS) if names is None else list(names)

    def payload(name: str) -> Column:
        # through an array of one, so that the payload is parsed once and not once per field
        parsed = F.filter(F.array(F.from_json("d", PAYLOADS[name])), lambda p: _whole(p, name))
        return F.when(F.col("op_name") == name, F.get(F.transform(parsed, lambda p: _filled(p, name)), F.lit(0)))

    rows = messages.where(F.col("op_name").isin(names) & ~F.col("malformed"))
    # made and judged as one value, so that no filter is worked out by parsing once more
    typed = F.array(F.struct("op_name", *[payload(name).alias(name) for name in names]))
    return rows.select(*_kept(messages), F.inline(F.filter(typed, lambda t: reduce(or_, [t[name].isNotNull() for name in names]))))


def reject_rows(messages: DataFrame) -> DataFrame:
    """Messages that are no message, and those whose payload lacks a required field."""

    def short(fields: tuple[str, ...]):
        def lacks(payload: Column) -> Column:
            missing = payload.isNull()
            for field in fields:
                missing = missing | payload[field].isNull()
            return missing

        return lacks

    lacking = F.lit(False)
    for name, fields in REQUIRED.items():
        # through an array of one, so that the payload is parsed once and not once per field
        payload = F.array(F.from_json("d", PAYLOADS[name]))
        lacking = F.when(F.col("op_name") == name, F.exists(payload, short(fields))).otherwise(lacking)
    return messages.where(F.col("malformed") | lacking)
