"""Job state from segment events, results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gopmill.operators import slices

RETAINED_LINES = 200
KINDS = ("assign", "complete", "failed")


def latest_segment_state(events: DataFrame) -> DataFrame:
    """The last event of each (job, segment) by ``seq``.

    A maximum, not a window: Spark reduces it before the shuffle, however often a segment reports.
    """
    rest = [c for c in events.columns if c not in ("job_id", "segment_id", "seq")]
    last = F.max(F.struct("seq", *rest)).alias("_last")
    return events.groupBy("job_id", "segment_id").agg(last).select("job_id", "segment_id", "_last.*")


def segment_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))


def _latest_kinds(events: DataFrame) -> DataFrame:
    """(job_id, segment_id, kind) of the last event of each segment.

    With a bigint ``seq`` and kinds as small numbers every buffer has a fixed size, so Spark hashes instead of sorting.
    """
    if dict(events.dtypes)["seq"] != "bigint":
        return latest_segment_state(events.select("job_id", "segment_id", "seq", "kind"))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).cast("int")
    last = events.groupBy("job_id", "segment_id").agg(F.max_by(code, "seq").alias("_code"))
    return last.select("job_id", "segment_id", F.get(F.array(*map(F.lit, KINDS)), F.col("_code") - 1).alias("kind"))


def job_progress(events: DataFrame, totals: DataFrame) -> DataFrame:
    """(job_id, total, completed, failed, assigned, pending) over the latest state of each segment.

    ``totals(job_id, total)``; a job without events is all pending.
    """
    counts = _latest_kinds(events).groupBy("job_id").agg(
        F.count_if(F.col("kind") == "complete").alias("completed"),
        F.count_if(F.col("kind") == "failed").alias("failed"),
        F.count_if(F.col("kind") == "assign").alias("assigned"),
    )
    filled = totals.join(counts, "job_id", "left").na.fill(0, ["completed", "failed", "assigned"])
    left = F.greatest(F.col("total") - F.col("completed") - F.col("failed") - F.col("assigned"), F.lit(0))
    return filled.select("job_id", "total", "completed", "failed", "assigned", left.cast("bigint").alias("pending"))


def job_state(progress: DataFrame) -> DataFrame:
    """Progress with ``is_complete``, ``is_success``, ``state`` and the failure ``message``."""
    complete = F.col("completed") + F.col("failed") >= F.col("total")
    success = (F.col("completed") >= F.col("total")) & (F.col("failed") == 0)
    failed = complete & (F.col("failed") > 0)
    message = F.concat(
        F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" segments failed")
    )
    return progress.select(
        "job_id", "total", "completed", "failed",
        complete.alias("is_complete"), success.alias("is_success"),
        F.when(failed, "Failed").when(complete, "Complete").otherwise("Processing").alias("state"),
        F.when(failed, message).alias("message"),
    )


def copied_and_encoded(copied: DataFrame, results: DataFrame) -> DataFrame:
    """Worker results and, for each copied segment, a result without encoding time.

    ``copied(job_id, segment_id, start_frame, end_frame, output_size_bytes)``.
    """
    frames = F.greatest(F.col("end_frame") - F.col("start_frame"), F.lit(0)) + 1
    made = copied.select(
        "job_id", "segment_id", frames.cast("bigint").alias("frames_encoded"),
        F.coalesce("output_size_bytes", F.lit(0)).cast("bigint").alias("output_size_bytes"),
        F.lit(0.0).alias("encoding_time_secs"),
    )
    return made.unionByName(results.select(*made.columns))


def results_with_segments(results: DataFrame, segments: DataFrame, key: str = "asset_id") -> DataFrame:
    """Results with their segment's ``duration``, 0.0 when there is no such segment."""
    spans = segments.select(key, "segment_id", (F.col("end_ts") - F.col("start_ts")).alias("duration"))
    return results.join(spans, [key, "segment_id"], "left").withColumn("duration", F.coalesce("duration", F.lit(0.0)))


def ordered_results(results: DataFrame, key: str = "job_id") -> DataFrame:
    return results.orderBy(key, "segment_id")


def run_totals(results: DataFrame, wall_secs: DataFrame | None = None) -> DataFrame:
    """Frames, bytes, MiB, seconds and frames per second of each job.

    ``wall_secs(job_id, wall_secs)`` where the elapsed time is known; else the summed encoding time counts.
    """
    totals = results.groupBy("job_id").agg(
        F.sum("frames_encoded").alias("total_frames"),
        F.sum("output_size_bytes").alias("total_bytes"),
        F.sum("encoding_time_secs").alias("encoding_secs"),
    )
    if wall_secs is not None:
        totals = totals.join(wall_secs, "job_id", "left")
    else:
        totals = totals.withColumn("wall_secs", F.col("encoding_secs"))
    return totals.select(
        "job_id", "total_frames", "total_bytes", (F.col("total_bytes") / 1048576.0).alias("total_mib"), "wall_secs",
        F.when(F.col("wall_secs") > 0, F.col("total_frames") / F.col("wall_secs")).alias("frames_per_sec"),
    )


def worker_rates(results: DataFrame) -> DataFrame:
    """Results with the rate of the worker that made them, null when it took no time."""
    took = F.col("encoding_time_secs")
    return results.withColumn("frames_per_sec", F.when(took > 0, F.col("frames_encoded") / took))


def node_result_counts(events: DataFrame) -> DataFrame:
    """Completed and failed segment reports per node."""
    return events.groupBy("node_id").agg(
        F.count_if(F.col("kind") == "complete").alias("segments_completed"),
        F.count_if(F.col("kind") == "failed").alias("segments_failed"),
    )


def retained_logs(lines: DataFrame, n: int = RETAINED_LINES) -> DataFrame:
    """The last n lines of each job, for any n without a window over all of a job's lines."""
    return slices.first_of_group(lines, ["job_id"], [F.col("seq").desc()], n, "_back").drop("_back")


def log_page(lines: DataFrame, offset: int = 0, limit: int = 100, n: int = RETAINED_LINES) -> DataFrame:
    """One page of each job's retained lines, with ``line_no`` from 0 and the ``total`` retained."""
    kept = retained_logs(lines, n)
    per_job = Window.partitionBy("job_id")
    numbered = kept.withColumn("line_no", (F.row_number().over(per_job.orderBy("seq")) - 1).cast("bigint")).withColumn(
        "total", F.count(F.lit(1)).over(per_job)
    )
    return numbered.where((F.col("line_no") >= offset) & (F.col("line_no") < offset + limit))


def job_summary(jobs: DataFrame, lines: DataFrame, n: int = RETAINED_LINES) -> DataFrame:
    """Job rows with ``log_count``, the number of lines kept; columns starting with an underscore stay inside."""
    counts = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("_lines"))
    shown = [c for c in jobs.columns if not c.startswith("_")]
    kept = F.least(F.coalesce("_lines", F.lit(0)), F.lit(n)).cast("bigint")
    return jobs.join(counts, "job_id", "left").select(*shown, kept.alias("log_count"))


# Branches of the phase table, first match wins; percents are fixed values.
FIXED_PERCENT = {"analyzing": 10, "count": 25, "split": 30, "final": 90, "complete": 100}
PHASE_OF_BRANCH = {
    "analyzing": "analyzing", "count": "splitting", "split": "splitting",
    "encode": "encoding", "final": "finalizing", "complete": "complete",
}
ENCODE_FROM, ENCODE_SPAN = 40, 45


def log_marks(lines: DataFrame) -> DataFrame:
    """Lines with what each one says: ``branch``, a new segment total, a finished segment."""
    low = F.lower("line")

    def says(*words: str):
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        return found

    branch = (
        F.when(says("analyzing"), "analyzing")
        .when(says("segments"), F.when(F.col("line").rlike(r"(?i)[0-9]+\s+segments"), "count"))
        .when(says("pre-split", "presplit_", "splitting"), "split")
        .when(says("segment_", "transcoding", "encoding"), "encode")
        .when(says("playlist", "concatenat", "assembling"), "final")
        .when(says("pipeline complete"), "complete")
    )
    # the plain searches spare most lines the patterns
    number = F.regexp_extract("line", r"(?i)Created\s+([0-9]+)\s+segments", 1).try_cast("bigint")
    created = F.when(says("created"), number)
    done = F.when(says("done"), F.col("line").rlike(r"(?i)Segment\s+[0-9]+\s+done\b")).otherwise(False)
    return lines.withColumns(
        {"branch": branch, "created": F.nullif(created, F.lit(0).cast("bigint")), "done": done.cast("int")}
    )


def encode_percent(done, total):
    """Percent an encoding line claims: 40 while the total is unknown."""
    share = F.least(F.lit(1.0), done / total)
    return F.when(total.isNull(), ENCODE_FROM).otherwise(ENCODE_FROM + F.round(share * ENCODE_SPAN).cast("int"))


def log_phase(lines: DataFrame, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Phase, percent, total and done segments of a job after each of its lines (job_id, seq, line).

    ``seq`` is a unique integer, its values may lie far apart. With n finished lines so far, the capped count of finished segments is
    n + min(0, lowest total - n at any finished line): a later, larger total does not give back what the cap took.
    Percent restarts at every line of a branch with a fixed percent and rises in between. What a slice of lines
    passes on is summed up without knowing what it starts from: its finished lines before its first total and
    the lowest (total - n) after it.
    """
    marked = log_marks(lines)
    fixed = F.col("branch").isin(*FIXED_PERCENT)
    base = F.lit(None).cast("int")
    for name, percent in FIXED_PERCENT.items():
        base = F.when(F.col("branch") == name, percent).otherwise(base)
    phase = F.lit(None).cast("string")
    for name, text in PHASE_OF_BRANCH.items():
        phase = F.when(F.col("branch") == name, text).otherwise(phase)
    local = slices.in_slice(["job_id"], ["seq"])
    run = slices.so_far(local)
    inside = (
        slices.sliced_by_rows(marked, ["job_id"], "seq", slice_rows)
        .withColumns({"_base": base, "_phase": phase})
        .withColumns(
            {
                "_n": F.sum("done").over(run),
                "_total": F.last("created", ignorenulls=True).over(run),
                "_group": F.sum(F.when(fixed, 1).otherwise(0)).over(run),
                "_phase_now": F.last("_phase", ignorenulls=True).over(run),
                "_base_now": F.last("_base", ignorenulls=True).over(run),
            }
        )
        # finished lines before the first total of the slice, and the lowest room left after it
        .withColumns(
            {
                "_open": F.sum(F.when(F.col("_total").isNull(), F.col("done")).otherwise(0)).over(run),
                "_room": F.min(F.when(F.col("done") == 1, F.col("_total") - F.col("_n"))).over(run),
            }
        )
    )
    # within a group the total is constant and the count rises, so the last encoding line is its highest
    last_encode = F.max(
        F.when(F.col("branch") == "encode", F.struct("_group", "seq", "_n", "_total", "_open", "_room"))
    )
    per_slice = inside.groupBy("job_id", slices.SLICE).agg(
        F.sum("done").alias("_s_n"),
        F.max_by("_total", "seq").alias("_s_total"),
        F.max("_open").alias("_s_open"),
        F.min("_room").alias("_s_room"),
        F.max("_group").alias("_s_group"),
        F.max_by("_base_now", "seq").alias("_s_base"),
        F.max_by("_phase_now", "seq").alias("_s_phase"),
        last_encode.alias("_s_encode"),
    )
    over = Window.partitionBy("job_id").orderBy(slices.SLICE)

    def lowest_room(total0, n0, opened, room):
        """Lowest (total - n) of a stretch that starts from total0 and n0; null while no total is known."""
        early = F.when(opened > 0, total0 - n0 - opened)
        return F.least(early, room - n0)

    started = per_slice.withColumns(
        {
            "_n0": F.coalesce(F.sum("_s_n").over(slices.before(over)), F.lit(0)),
            "_total0": F.last("_s_total", ignorenulls=True).over(slices.before(over)),
        }
    )
    roomed = started.withColumn(
        "_low", lowest_room(F.col("_total0"), F.col("_n0"), F.col("_s_open"), F.col("_s_room"))
    ).withColumn("_low0", F.min("_low").over(slices.before(over)))
    enc = F.col("_s_encode")
    low_then = F.least(F.col("_low0"), lowest_room(F.col("_total0"), F.col("_n0"), enc["_open"], enc["_room"]))
    done_then = F.col("_n0") + enc["_n"] + F.least(F.lit(0), F.coalesce(low_then, F.lit(0)))
    claimed = F.when(
        enc.isNotNull() & (enc["_group"] == F.col("_s_group")),
        encode_percent(done_then, F.coalesce(enc["_total"], F.col("_total0"))),
    )
    ended = roomed.withColumns(
        {
            "_top": F.greatest(F.when(F.col("_s_group") > 0, F.col("_s_base")), claimed),
            "_epoch": F.sum(F.when(F.col("_s_group") > 0, 1).otherwise(0)).over(slices.so_far(over)),
        }
    ).withColumn(
        "_end", F.max("_top").over(slices.so_far(Window.partitionBy("job_id", "_epoch").orderBy(slices.SLICE)))
    )
    inherited = ended.select(
        "job_id", slices.SLICE, "_n0", "_total0", "_low0",
        F.coalesce(F.lag("_end").over(over), F.lit(0)).alias("_percent0"),
        F.last("_s_phase", ignorenulls=True).over(slices.before(over)).alias("_phase0"),
    )
    total = F.coalesce("_total", "_total0")
    low = F.least(F.col("_low0"), lowest_room(F.col("_total0"), F.col("_n0"), F.col("_open"), F.col("_room")))
    joined = slices.join_null_safe(inside, inherited, ["job_id", slices.SLICE]).withColumns(
        {
            "segments_total": F.coalesce(total, F.lit(0)).cast("bigint"),
            "segments_done": (F.col("_n0") + F.col("_n") + F.least(F.lit(0), F.coalesce(low, F.lit(0)))).cast("bigint"),
        }
    )
    here = F.when(
        F.col("branch") == "encode",
        encode_percent(F.col("segments_done"), F.when(F.col("segments_total") > 0, F.col("segments_total"))),
    ).otherwise(F.col("_base"))
    grouped = slices.so_far(Window.partitionBy("job_id", slices.SLICE, "_group").orderBy("seq"))
    start = F.when(F.col("_group") == 0, F.col("_percent0")).otherwise(0)
    return joined.withColumn("_here", here).select(
        *lines.columns,
        F.coalesce("_phase_now", "_phase0", F.lit("starting")).alias("phase"),
        F.greatest(start, F.coalesce(F.max("_here").over(grouped), F.lit(0))).cast("int").alias("percent"),
        "segments_total", "segments_done",
    )
