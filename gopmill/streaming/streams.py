"""Streaming operators. Each takes and gives streaming DataFrames; its batch twin is named in its docstring.

Inputs carry the event time ``ts`` (timestamp, ms). Rows later than ``delay`` behind the newest are dropped by the
watermark and counted in the query's metrics, which ``late.LateRows`` writes down. Keyed folds run on the RocksDB state
store; see ``runner``. Folds of jobs and uploads forget a key ``keep_secs`` after its last row, KEEP_SECS by default; None
keeps it for ever.
Numbers that may be absent go into a fold as -1: pandas would turn a nullable bigint into a float.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gopmill.functions.requests import validate_request
from gopmill.operators.jobs import FIXED_PERCENT, PHASE_OF_BRANCH, log_marks
from gopmill.sources.messages import payload_rows
from gopmill.streaming.ordered import InOrder

SHARDS = 64
KEEP_SECS = 7 * 86400


def _timed(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("ts", F.date_trunc("millisecond", F.col("ts").cast("timestamp"))).withWatermark("ts", delay)


# -- nodes ----------------------------------------------------------------------------------------------------


class _Liveness(InOrder):
    columns = ("active_workers", "max_concurrent_workers", "initial_status")
    pending_schema = "ts bigint, active_workers bigint, max_workers bigint, initial string"
    state_schema = "status string, last_ms bigint"
    outputs = ("node_id", "at", "status")

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def start(self, key):
        return None, None

    def before_rows(self, key, facts):
        # registration counts as the first sign of life
        at = int(facts["registered_ms"])
        return (facts["status"], at), at

    def _dead(self, key, status, last, now):
        if last is None or status == "Dead" or now - last <= self.timeout:
            return status, []
        return "Dead", [(key[0], pd.Timestamp(last + self.timeout, unit="ms"), "Dead")]

    def fold(self, key, state, row):
        at, active, most, initial = row
        status, last = state
        status = initial if status is None else status
        status, out = self._dead(key, status, last, at)
        if active >= most:
            after = "Busy"
        else:
            after = "Active" if status in ("Busy", "Dead") else status
        if after != status:
            out.append((key[0], pd.Timestamp(at, unit="ms"), after))
        return (after, at), out

    def idle(self, key, state, now_ms):
        status, last = state
        status, out = self._dead(key, status, last, now_ms)
        return (None if status is None else (status, last)), out

    def wake_at(self, state):
        status, last = state
        return None if last is None or status == "Dead" else last + self.timeout + 1


def node_liveness_stream(
    heartbeats: DataFrame, nodes: DataFrame, timeout_secs: float = 10, delay: str = "10 seconds", clock: DataFrame | None = None
) -> DataFrame:
    """(node_id, at, status) for each change of a registered node's status. Twin: latest_status, silent_intervals.

    ``nodes`` is a table (node_id, max_concurrent_workers, status). A silent node is Dead once the watermark
    passes its last beat by the timeout; where all nodes may fall silent at once, pass a ``clock`` stream (ts), whose
    rows only move its watermark and reach no node's state, and let the session's ``multipleWatermarkPolicy`` be ``max``. With ``registered_at`` in ``nodes`` a node's state begins with
    its registration, so one that never beats dies too, and beats from before it are an unknown node's; nodes registered
    after the first batch begin with their first beat.
    """
    node_type = dict(heartbeats.dtypes)["node_id"]
    timed = "registered_at" in nodes.columns
    registry = nodes.select(
        "node_id", F.col("max_concurrent_workers").cast("bigint"), F.col("status").alias("initial_status"), *["registered_at"] * timed
    )
    beats = _timed(heartbeats.select("node_id", "ts", F.col("active_workers").cast("bigint").alias("active_workers")), delay)
    if clock is not None:
        ticks = _timed(clock.select("ts"), delay).select(
            F.lit("-1").cast(node_type).alias("node_id"), "ts", F.lit(-1).cast("bigint").alias("active_workers")
        )
        # a filter that names the event time stays above the watermark, which so has seen the ticks that end here
        beats = beats.unionByName(ticks.where(F.col("ts").isNull()))
    known = beats.join(registry, "node_id")
    initial = None
    if timed:
        known = known.where(F.coalesce(F.col("ts") >= F.col("registered_at").cast("timestamp"), F.lit(True))).drop("registered_at")
        since = F.unix_millis(F.col("registered_at").cast("timestamp")).alias("registered_ms")
        initial = nodes.where(F.col("registered_at").isNotNull()).select("node_id", "status", since).groupBy("node_id")
    return known.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=_Liveness(int(timeout_secs * 1000)),
        outputStructType=f"node_id {node_type}, at timestamp, status string",
        outputMode="append", timeMode="EventTime", initialState=initial,
    )


def membership_events(messages: DataFrame) -> DataFrame:
    """(node_id, ts, joined, address, status, max_concurrent_workers) from Identify, Identified and NodeLeave."""
    one = payload_rows(messages, "Identify").select(
        "node_id", "ts", F.lit(True).alias("joined"), F.col("listen_addr").alias("address"), F.lit("Active").alias("status"),
        F.col("capabilities.max_concurrent_workers").alias("max_concurrent_workers"),
    )
    listed = payload_rows(messages, "Identified").select("ts", F.explode("cluster_nodes").alias("n")).select(
        "n.node_id", "ts", F.lit(True).alias("joined"), "n.address", "n.status",
        F.col("n.capabilities.max_concurrent_workers").alias("max_concurrent_workers"),
    )
    left = payload_rows(messages, "NodeLeave").select("node_id", "ts", F.lit(False).alias("joined"))
    return one.unionByName(listed).unionByName(left, allowMissingColumns=True)


def node_membership_stream(messages: DataFrame) -> DataFrame:
    """Latest membership of each node, ``joined`` false once it left; run in update or complete mode.

    One state row per node; works on a table just as well, which is its twin. At one instant a leave comes last.
    """
    events = membership_events(messages)
    facts = F.struct("ts", (~F.col("joined")).alias("left"), "address", "status", "max_concurrent_workers")
    latest = events.groupBy("node_id").agg(F.max(facts).alias("m"))
    return latest.select("node_id", "m.ts", (~F.col("m.left")).alias("joined"), "m.address", "m.status", "m.max_concurrent_workers")


# -- jobs -----------------------------------------------------------------------------------------------------


class _Progress(StatefulProcessor):
    """Counts per (job, shard) over the latest state of each segment; order of arrival does not matter."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segments = handle.getMapState("segments", "segment_id bigint", "seq bigint, kind string")
        self.counts = handle.getValueState("counts", "seen bigint, version bigint, completed bigint, failed bigint, assigned bigint")

    def handleInputRows(self, key, rows, timerValues):
        newest: dict[int, tuple[int, str]] = {}
        found = self.counts.get()
        known = found is not None  # else it has neither segments nor a timer
        seen, version, *tally = found if known else (0, 0, 0, 0, 0)
        for row in rows:
            if row.segment_id not in newest or row.seq > newest[row.segment_id][0]:
                newest[row.segment_id] = (row.seq, row.kind)
            if self.keep_ms is not None and row.at_ms is not None:
                seen = max(seen, row.at_ms)
        place = {"complete": 0, "failed": 1, "assign": 2}
        for segment, (seq, kind) in newest.items():
            old = self.segments.getValue((segment,)) if known else None
            if old is not None:
                old_seq, old_kind = old
                if old_seq >= seq:
                    continue
                if old_kind in place:
                    tally[place[old_kind]] -= 1
            if kind in place:  # any other kind counts as nothing, as in the batch form
                tally[place[kind]] += 1
            self.segments.updateValue((segment,), (seq, kind))
        # counts that begin again after they were forgotten come after the old ones
        version = max(version + 1, seen)
        self.counts.update((seen, version, *tally))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()) if known else []:
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(seen + self.keep_ms)
        yield Row(job_id=key[0], shard=key[1], version=version, completed=tally[0], failed=tally[1], assigned=tally[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.segments.clear()
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_progress_stream(
    events: DataFrame, shards: int = SHARDS, keep_secs: int | None = KEEP_SECS, delay: str = "1 day"
) -> DataFrame:
    """(job_id, shard, version, completed, failed, assigned), one update per key and batch. Twin: job_progress.

    A job's segments are spread over shards, so one large job is not one task; ``job_progress_totals`` adds them up. Where
    the events have a ``ts``, a shard with its segments is forgotten once the watermark is ``keep_secs`` past its last report,
    and a report after that counts anew; without it, or with None, every segment is kept. ``seq`` is a bigint.
    """
    timed = keep_secs is not None and "ts" in events.columns
    keyed = events.select(
        "job_id", F.pmod("segment_id", F.lit(shards)).cast("int").alias("shard"), "segment_id",
        F.coalesce("seq", F.lit(-1)).alias("seq"), "kind", *["ts"] * timed,
    )
    job_type = dict(events.dtypes)["job_id"]
    if timed:
        keyed = _timed(keyed, delay).withColumn("at_ms", F.unix_millis("ts"))
    # rows, not pandas: a key has a few of them a batch, and a DataFrame for each key costs more than they do
    return keyed.groupBy("job_id", "shard").transformWithState(
        statefulProcessor=_Progress(int(keep_secs * 1000) if timed else None),
        outputStructType=f"job_id {job_type}, shard int, version bigint, completed bigint, failed bigint, assigned bigint",
        outputMode="update", timeMode="EventTime" if timed else "None",
    )


def job_progress_totals(updates: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress per job from the written updates of ``job_progress_stream``: the last version of each shard, summed."""
    last = updates.groupBy("job_id", "shard").agg(
        F.max(F.struct("version", "completed", "failed", "assigned")).alias("u")
    )
    counts = last.groupBy("job_id").agg(*[F.sum(f"u.{c}").alias(c) for c in ("completed", "failed", "assigned")])
    filled = totals.join(counts, "job_id", "left").na.fill(0, ["completed", "failed", "assigned"])
    left = F.greatest(F.col("total") - F.col("completed") - F.col("failed") - F.col("assigned"), F.lit(0))
    return filled.select("job_id", "total", "completed", "failed", "assigned", left.alias("pending"))


class _Phase(InOrder):
    columns = ("seq", "branch", "created", "done")
    pending_schema = "ts bigint, seq bigint, branch string, created bigint, done bigint"
    state_schema = "phase string, percent bigint, total bigint, done bigint"
    outputs = ("job_id", "seq", "phase", "percent", "segments_total", "segments_done")

    def __init__(self, keep_secs: float | None):
        self.keep_ms = None if keep_secs is None else int(keep_secs * 1000)

    def start(self, key):
        return "starting", 0, 0, 0

    def fold(self, key, state, row):
        phase, percent, total, done = state
        _, seq, branch, created, finished = row
        if created > 0:
            total = created
        if finished:
            done = min(done + 1, total) if total else done + 1
        if branch in FIXED_PERCENT:
            percent = FIXED_PERCENT[branch]
        elif branch == "encode":
            claim = 40 if not total else 40 + int(min(1.0, done / total) * 45 + 0.5)
            percent = max(percent, claim)
        phase = PHASE_OF_BRANCH.get(branch, phase)
        return (phase, percent, total, done), [(key[0], seq, phase, percent, total, done)]


def log_phase_stream(lines: DataFrame, delay: str = "10 seconds", keep_secs: int | None = KEEP_SECS) -> DataFrame:
    """Phase, percent and counts after each line (job_id, ts, seq, line). Twin: log_phase.

    What a line says is found by column expressions before the state: the fold sees four short values a line. A job is
    forgotten ``keep_secs`` after its last line.
    """
    marked = log_marks(lines).select(
        "job_id", "ts", "seq", "branch", F.coalesce("created", F.lit(-1)).alias("created"), F.col("done").cast("bigint").alias("done")
    )
    job_type = dict(lines.dtypes)["job_id"]
    return _timed(marked, delay).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Phase(keep_secs),
        outputStructType=f"job_id {job_type}, seq bigint, phase string, percent int, segments_total bigint, segments_done bigint",
        outputMode="append", timeMode="EventTime",
    )


class _Percent(InOrder):
    columns = ("seq", "completed_segments", "total_segments", "percent")
    pending_schema = "ts bigint, seq bigint, completed bigint, total bigint, percent bigint"
    state_schema = "percent bigint"
    outputs = ("job_id", "seq", "completed_segments", "total_segments", "percent")

    def __init__(self, keep_secs: float | None):
        self.keep_ms = None if keep_secs is None else int(keep_secs * 1000)

    def start(self, key):
        return (0,)

    def fold(self, key, state, row):
        _, seq, completed, total, own = row
        percent = state[0] if own < 0 else own
        return (percent,), [(key[0], seq, completed, total, percent)]


def progress_rows(messages: DataFrame) -> DataFrame:
    """Progress messages with their percent, null while the total is 0; needs no state."""
    rows = payload_rows(messages, "JobProgress")
    share = F.col("completed_segments") / F.col("total_segments")
    percent = F.when(F.col("total_segments") > 0, F.round(share * 100).cast("bigint"))
    return rows.withColumn("percent", percent)


def progress_percent_stream(messages: DataFrame, delay: str = "10 seconds", keep_secs: int | None = KEEP_SECS) -> DataFrame:
    """Progress messages (ts, seq, raw parsed by read_messages) with a percent that outlasts a total of 0.

    A job is forgotten ``keep_secs`` after its last message.
    """
    rows = progress_rows(messages).select("job_id", "ts", "seq", "completed_segments", "total_segments", F.coalesce("percent", F.lit(-1)).alias("percent"))
    return _timed(rows, delay).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Percent(keep_secs),
        outputStructType="job_id string, seq bigint, completed_segments bigint, total_segments bigint, percent bigint",
        outputMode="append", timeMode="EventTime",
    )


# -- requests and grants ------------------------------------------------------------------------------------------


def request_rate(requests: DataFrame, limit: int = 30, window: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """(client_id, window_start, requests, limited): requests per client and clock-aligned window. Runs on tables too."""
    counted = _timed(requests, delay).groupBy("client_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(
        "client_id", F.col("window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited")
    )


class _Redeem(InOrder):
    # a grant sorts before the attempts of its instant
    columns = ("is_attempt", "attempt_id", "job_id", "filename")
    pending_schema = "ts bigint, is_attempt bigint, attempt_id bigint, job_id string, filename string"
    state_schema = "expires bigint, job_id string, filename string"
    outputs = ("ticket", "attempt_id", "redeemed")

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def start(self, key):
        return None, None, None

    def fold(self, key, state, row):
        at, is_attempt, attempt, job, name = row
        if not is_attempt:
            return (at + self.ttl, job, name), []
        expires, for_job, for_name = state
        met = expires is not None and expires > at and (job, name) == (for_job, for_name)
        # a mismatched attempt does not spend the grant
        return (None if met else state), [(key[0], attempt, met)]

    def idle(self, key, state, now_ms):
        gone = state[0] is None or state[0] <= now_ms
        return (None if gone else state), []

    def wake_at(self, state):
        return state[0]


def grant_redemption_stream(grants: DataFrame, attempts: DataFrame, ttl_secs: float = 60, delay: str = "10 seconds") -> DataFrame:
    """(ticket, attempt_id, redeemed) of each attempt. Twin: redeem_grants.

    ``grants(ticket, job_id, filename, issued_at)``, ``attempts(ticket, attempt_id, job_id, filename, ts)``. A grant's
    state goes when it is met or expires.
    """
    ticket_type = dict(grants.dtypes)["ticket"]
    issued = grants.select(
        "ticket", F.col("issued_at").alias("ts"), F.lit(0).cast("bigint").alias("is_attempt"),
        F.lit(-1).cast("bigint").alias("attempt_id"), F.col("job_id").cast("string").alias("job_id"), "filename",
    )
    tried = attempts.select(
        "ticket", "ts", F.lit(1).cast("bigint").alias("is_attempt"), "attempt_id",
        F.col("job_id").cast("string").alias("job_id"), "filename",
    )
    both = _timed(issued.unionByName(tried), delay)
    return both.groupBy("ticket").transformWithStateInPandas(
        statefulProcessor=_Redeem(int(ttl_secs * 1000)),
        outputStructType=f"ticket {ticket_type}, attempt_id bigint, redeemed boolean",
        outputMode="append", timeMode="EventTime",
    )


def split_requests(columns: dict, valid_path: str, rejected_path: str, **rules):
    """A foreachBatch writer of valid and rejected requests. Twin: validate_request.

    Each batch owns a folder that a repeated batch overwrites, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("_verdict", validate_request(columns, **rules)).persist()
        valid = judged.where(F.col("_verdict").isNull()).drop("_verdict")
        rejected = judged.where(F.col("_verdict").isNotNull()).select(*batch.columns, "_verdict.field", "_verdict.error")
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        judged.unpersist()

    return write


def ingest_sources_once_stream(attempts: DataFrame, keep_secs: int | None = KEEP_SECS) -> DataFrame:
    """The first successful attempt of each upload to arrive. Twin: ingest_sources_once.

    ``attempts(upload_id, ok, ts, ...)``. One state row per upload, until the watermark, ``keep_secs`` behind the newest
    attempt, has passed the attempt that counted by ``keep_secs``; attempts later than the watermark are dropped.
    """
    fit = attempts.where(F.col("ok"))
    if keep_secs is None:
        return fit.dropDuplicates(["upload_id"])
    return _timed(fit, f"{keep_secs} seconds").dropDuplicatesWithinWatermark(["upload_id"])


# -- packets ----------------------------------------------------------------------------------------------------


class _LiveGops(InOrder):
    columns = ("packet_idx", "pts_time", "size_bytes", "is_key", "is_end")
    pending_schema = "ts bigint, packet_idx bigint, pts_time double, size_bytes bigint, is_key boolean, is_end boolean"
    state_schema = "gop_idx bigint, start_frame bigint, start_time double, end_frame bigint, end_time double, size_bytes bigint"
    outputs = ("asset_id", "gop_idx", "start_frame", "end_frame", "start_time", "end_time", "size_bytes", "bitrate_bps")

    def __init__(self, keep_secs: float | None):
        self.keep_ms = None if keep_secs is None else int(keep_secs * 1000)

    def expired(self, key, state):
        return self._closed(key, state)

    def start(self, key):
        return 0, None, 0.0, None, None, 0

    def _closed(self, key, state):
        gop, first, began, last, ended, size = state
        if first is None:
            return []
        lasted = ended - began
        return [(key[0], gop, first, last, began, ended, size, size * 8.0 / lasted if lasted > 0.001 else 0.0)]

    def fold(self, key, state, row):
        _, index, pts, size, key_packet, end = row
        if end:
            return None, self._closed(key, state)
        if key_packet and index > 0:
            closed = self._closed(key, state)
            gop = state[0] + 1
            return (gop, index, pts, index, pts, size), closed
        gop, first, began, _, _, total = state
        return (gop, index if first is None else first, began, index, pts, total + size), []


def live_gop_stats(packets: DataFrame, delay: str = "10 seconds", keep_secs: int | None = KEEP_SECS) -> DataFrame:
    """GOPs as the next keyframe closes them. Twin: gop_stats.

    Packets(asset_id, ts, packet_idx, pts_time, size_bytes, flags, is_end); a row with ``is_end`` after an asset's
    last packet closes its last GOP and frees its state; so does a silence of ``keep_secs``. One asset is one encoder's output, some tens of packets a
    second, and every asset is its own key.
    """
    keyed = packets.withColumn("is_key", F.coalesce(F.col("flags").contains("K"), F.lit(False)))
    return _timed(keyed.drop("flags"), delay).groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=_LiveGops(keep_secs),
        outputStructType=(
            "asset_id bigint, gop_idx bigint, start_frame bigint, end_frame bigint, start_time double, end_time double, "
            "size_bytes bigint, bitrate_bps double"
        ),
        outputMode="append", timeMode="EventTime",
    )
