"""Keyframe-aligned segments: nearest keyframe, greedy cutting, fixed cuts, measures per segment."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gopmill.operators import slices
from gopmill.operators.rangejoin import ROWS_PER_TASK, SALT, point_join, spread_hot
from gopmill.session import written

# Frames per block at each level of the chain; see visited_keyframes.
CHAIN_BLOCKS = (1 << 14, 1 << 26)
# Where the last link of a chain leads.
END = -1
# Frames per join bucket: about a segment, so that a frame is compared with one or two segments.
BUCKET_FRAMES = 256
BYTES_PER_SECOND = 5 * 1024 * 1024
# Segments that a source gets in one run, and the sources whose equal runs are written together.
SEGMENTS_PER_RUN, SOURCES_PER_RUN = 1 << 9, 1 << 8


def _nearest(targets: DataFrame, marks: DataFrame, at: str, payload: Sequence[str], slice_rows: int) -> DataFrame:
    """Targets with ``nearest`` = struct(frame_idx, *payload) of the closest mark of their asset.

    Targets and marks are lined up in one frame order; each target compares the last mark at or before it with
    the first one after it, a tie going to the earlier. No join, no pairs.
    """
    mark_struct = F.struct("frame_idx", *payload)
    columns = [c for c in targets.columns if c != "asset_id"]
    lined = targets.select(
        "asset_id", F.col(at).alias("_at"), F.lit(1).alias("_is_target"), F.struct(*columns).alias("_target"),
        F.lit(None).cast(marks.select(mark_struct).schema[0].dataType).alias("_mark"),
    ).unionByName(
        marks.select(
            "asset_id", F.col("frame_idx").alias("_at"), F.lit(0).alias("_is_target"),
            F.lit(None).cast(targets.select(F.struct(*columns)).schema[0].dataType).alias("_target"),
            mark_struct.alias("_mark"),
        )
    )
    carried = slices.inherit(
        lined,
        ["asset_id"],
        slices.slice_of("_at", slice_rows),
        [F.min("_mark").alias("_first"), F.max("_mark").alias("_last")],
        lambda w: [
            F.last("_last", ignorenulls=True).over(slices.before(w)).alias("_earlier"),
            F.first("_first", ignorenulls=True).over(slices.after(w)).alias("_later"),
        ],
    )
    inside = slices.in_slice(["asset_id"], ["_at", "_is_target"])
    back = F.coalesce(F.last("_mark", ignorenulls=True).over(slices.so_far(inside)), F.col("_earlier"))
    # backwards, as a frame that runs to the end would be gone through anew for each row
    backwards = slices.in_slice(["asset_id"], [F.col("_at").desc(), F.col("_is_target").desc()])
    ahead = F.coalesce(F.last("_mark", ignorenulls=True).over(slices.before(backwards)), F.col("_later"))
    seen = carried.select("asset_id", "_at", "_is_target", "_target", back.alias("_back"), ahead.alias("_ahead"))
    closer_back = F.col("_at") - F.col("_back.frame_idx") <= F.col("_ahead.frame_idx") - F.col("_at")
    nearest = (
        F.when(F.col("_back").isNull(), F.col("_ahead"))
        .when(F.col("_ahead").isNull() | closer_back, F.col("_back"))
        .otherwise(F.col("_ahead"))
    )
    return seen.where(F.col("_is_target") == 1).select("asset_id", "_target.*", nearest.alias("nearest"))


def nearest_keyframe(
    targets: DataFrame,
    keyframes: DataFrame,
    slice_rows: int = slices.SLICE_ROWS,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Targets(asset_id, target_frame, ...) with ``kf_idx``, the index of the closest keyframe.

    Clamped at both ends, null for an asset without keyframes. Equal targets are looked up once, so a value
    asked for by very many rows fills no slice; its rows are split before they get the answer.
    """
    distinct = targets.select("asset_id", "target_frame").distinct()
    found = _nearest(distinct, keyframes, "target_frame", ["kf_idx"], slice_rows).select(
        "asset_id", "target_frame", F.col("nearest.kf_idx").alias("kf_idx")
    )
    dealt, repeated, on = spread_hot(targets, found, ["asset_id", "target_frame"], rows_per_task)
    return dealt.join(repeated, on).select(*targets.columns, "kf_idx")


def segment_links(
    media: DataFrame, keyframes: DataFrame, target_secs: float, slice_rows: int = slices.SLICE_ROWS
) -> DataFrame:
    """Every keyframe with the keyframe the next segment would start at, if one started here.

    ``succ_frame`` is null where the segment would run to the end of the asset.
    """
    facts = media.select(
        "asset_id", "total_frames", "duration_secs",
        F.round(F.lit(float(target_secs)) * F.col("fps")).cast("bigint").alias("_span"),
    ).where((F.col("total_frames") > 0) & (F.col("_span") > 0))
    dealt, repeated, on = spread_hot(keyframes, facts, ["asset_id"])
    chained = slices.following(
        dealt.join(repeated, on).drop(SALT), ["asset_id"], slices.slice_of("frame_idx", slice_rows), ["frame_idx"],
        {"frame_idx": "_next_frame", "ts": "_next_ts"},
    )
    targets = chained.withColumn("_goal", F.col("frame_idx") + F.col("_span")).drop("_span")
    found = _nearest(targets, keyframes, "_goal", ["ts"], slice_rows)
    ahead = F.col("nearest.frame_idx") > F.col("frame_idx")
    runs_out = F.col("_goal") >= F.col("total_frames")
    return found.select(
        "asset_id", "kf_idx", "frame_idx", "ts", "total_frames", "duration_secs",
        F.col("_next_frame").isNull().alias("is_last"),
        F.when(~runs_out, F.when(ahead, F.col("nearest.frame_idx")).otherwise(F.col("_next_frame"))).alias("succ_frame"),
        F.when(~runs_out, F.when(ahead, F.col("nearest.ts")).otherwise(F.col("_next_ts"))).alias("succ_ts"),
    )


def _chain(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's links in order: frames, where each leads, the place of that in the block or its own, and the ways in."""
    columns = [table.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "to", "is_way_in")]
    ways = columns[2].astype(bool)
    frames, to = columns[0][~ways].astype(np.int64), columns[1][~ways].astype(np.int64)
    order = np.argsort(frames, kind="stable")
    frames, to = frames[order], to[order]
    at = np.minimum(np.searchsorted(frames, to), max(len(frames) - 1, 0))
    here = np.arange(len(frames))
    step = np.where(frames[at] == to, at, here) if len(frames) else here
    entered = np.unique(columns[0][ways].astype(np.int64))
    entered = entered[np.isin(entered, frames)]
    return frames, to, step, np.searchsorted(frames, entered)


def _result(table: pa.Table, frames: np.ndarray, **more: np.ndarray) -> pa.Table:
    asset = pa.array([table.column("asset_id")[0].as_py()] * len(frames), table.schema.field("asset_id").type)
    return pa.table({"asset_id": asset, "frame": pa.array(frames, pa.int64()), **more})


def _shortcuts(table: pa.Table) -> pa.Table:
    """Where the walk from each way into a block leaves it: every place jumps to the place its jump leads to, until all rest."""
    frames, to, step, entered = _chain(table)
    while not np.array_equal(step, further := step[step]):
        step = further
    left = to[step[entered]]
    return _result(table, frames[entered], to=pa.array(left, pa.int64(), mask=left == END))


def _walk(table: pa.Table) -> pa.Table:
    """The places that the walks from a block's ways in visit."""
    frames, _, step, entered = _chain(table)
    seen = np.zeros(len(frames), bool)
    for at in entered.tolist():
        while not seen[at]:
            seen[at] = True
            at = step[at]
    return _result(table, frames[seen])


def visited_keyframes(links: DataFrame, entries: DataFrame, blocks: Sequence[int] = CHAIN_BLOCKS) -> DataFrame:
    """(asset_id, frame) of the keyframes a walk from each asset's entry visits.

    ``links(asset_id, frame, to)`` always lead forward, null at an end; ``entries(asset_id, frame)``. The walk
    is sequential, so it is cut into blocks of frames: within a block the way out from every frame some other block
    leads into is found by doubling jumps, for all of them at once; those shortcuts are the links of the next, coarser
    level. Only the coarsest level is walked asset by asset, over one link per block and way in. A task holds the links of
    one block and its ways in, once each.
    """
    kind = links.schema["asset_id"].dataType.simpleString()
    end = F.lit(END).cast("bigint")

    def block(column: str) -> Column:
        return F.floor(F.col(column) / F.lit(blocks[0])).cast("bigint") if blocks else F.lit(0).cast("bigint")

    steps = links.select("asset_id", F.col("frame").cast("bigint").alias("frame"), F.coalesce("to", end).alias("to"), F.lit(False).alias("is_way_in"))

    def with_ways(ways: DataFrame):
        rows = ways.select("asset_id", F.col("frame").cast("bigint").alias("frame"), end.alias("to"), F.lit(True).alias("is_way_in"))
        return steps.unionByName(rows).withColumn("_block", block("frame")).groupBy("asset_id", "_block")

    if blocks:
        into = links.where(F.col("to").isNotNull() & (block("to") != block("frame"))).select("asset_id", F.col("to").alias("frame"))
        shortcuts = with_ways(into.unionByName(entries)).applyInArrow(_shortcuts, f"asset_id {kind}, frame bigint, to bigint")
        entries = visited_keyframes(shortcuts, entries, blocks[1:])
    return with_ways(entries).applyInArrow(_walk, f"asset_id {kind}, frame bigint")


def create_segments(
    media: DataFrame,
    keyframes: DataFrame,
    target_secs: float = 10.0,
    keep_tail: bool = False,
    slice_rows: int = slices.SLICE_ROWS,
    blocks: Sequence[int] = CHAIN_BLOCKS,
) -> DataFrame:
    """Greedy keyframe-aligned cutting: each segment ends at the keyframe nearest to ``target_secs`` on.

    (asset_id, segment_id, start_frame, end_frame, start_ts, end_ts). ``media`` needs asset_id, fps, total_frames
    and duration_secs. A last keyframe on the last frame yields no segment of its own unless ``keep_tail``.
    Assets that cannot be cut are in ``segment_rejects``.
    """
    # some tens of packets share a keyframe, so these writes are small beside one more pass over packets
    links = written(segment_links(media, written(keyframes), target_secs, slice_rows))
    steps = links.select("asset_id", F.col("frame_idx").alias("frame"), F.col("succ_frame").alias("to"))
    entries = links.where(F.col("kf_idx") == 0).select("asset_id", F.col("frame_idx").alias("frame"))
    visited = written(visited_keyframes(steps, entries, list(blocks))).withColumnRenamed("frame", "frame_idx")
    cut = links.join(visited, ["asset_id", "frame_idx"])
    if not keep_tail:
        lost = (
            F.col("succ_frame").isNull() & F.col("is_last") & (F.col("kf_idx") > 0)
            & (F.col("total_frames") - 1 <= F.col("frame_idx"))
        )
        cut = cut.where(~lost)
    spans = cut.select(
        "asset_id",
        F.col("frame_idx").alias("start_frame"),
        F.coalesce(F.col("succ_frame"), F.col("total_frames")).alias("_stop"),
        F.col("ts").alias("start_ts"),
        F.when(F.col("succ_frame").isNull(), F.col("duration_secs")).otherwise(F.col("succ_ts")).alias("end_ts"),
    ).withColumn("end_frame", F.col("_stop") - 1)
    numbered = slices.row_number(
        spans, ["asset_id"], slices.slice_of("start_frame", slice_rows), ["start_frame"], "segment_id", start=0
    )
    return numbered.select("asset_id", "segment_id", "start_frame", "end_frame", "start_ts", "end_ts")


def segment_rejects(media: DataFrame, keyframes: DataFrame, target_secs: float = 10.0) -> DataFrame:
    """(asset_id, reason) of the assets ``create_segments`` cannot cut."""
    has_keys = keyframes.where(F.col("kf_idx") == 0).select("asset_id", F.lit(True).alias("_has"))
    span = F.round(F.lit(float(target_secs)) * F.col("fps")).cast("bigint")
    reason = (
        F.when(F.coalesce("total_frames", F.lit(0)) == 0, "Video has no frames to segment")
        .when(F.col("_has").isNull(), "No keyframes detected")
        .when(F.coalesce(span, F.lit(0)) <= 0, "Target segment duration too small for video frame rate")
    )
    return (
        media.join(has_keys, "asset_id", "left")
        .select("asset_id", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def fixed_segments(media: DataFrame, secs: float = 10.0, fps: float = 30.0) -> DataFrame:
    """Equal time ranges of ``secs``, the last one clipped to the duration; frames are estimated at ``fps``."""
    count = F.ceil(F.col("duration_secs") / F.lit(float(secs))).cast("bigint")
    start = F.col("segment_id") * F.lit(float(secs))
    end = F.least((F.col("segment_id") + 1) * F.lit(float(secs)), F.col("duration_secs"))
    return (
        media.where(count > 0)
        .select("asset_id", "duration_secs", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("segment_id"))
        .withColumn("start_ts", start)
        .withColumn("end_ts", end)
        .select(
            "asset_id", "segment_id", F.lit(0).cast("bigint").alias("start_frame"),
            F.greatest((F.col("end_ts") - F.col("start_ts")) * F.lit(fps), F.lit(1.0)).cast("bigint").alias("end_frame"),
            "start_ts", "end_ts", F.lit(0.5).alias("complexity_estimate"),
        )
    )


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with the same run, at most SOURCES_PER_RUN of them, as one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        first, rows = (batch.column(c).to_numpy() for c in ("_first", "_rows"))
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rows[1:] != rows[:-1])]))
        ends = np.append(new[1:], len(first))
        starts = np.concatenate([np.arange(lo, hi, SOURCES_PER_RUN) for lo, hi in zip(new.tolist(), ends.tolist(), strict=True)])
        each = pa.StructArray.from_arrays([batch.column("asset_id"), batch.column("_lasted")], names=["asset_id", "_lasted"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(first)), pa.int32()), each)
        yield pa.RecordBatch.from_arrays([pa.array(first[starts]), pa.array(rows[starts]), lists], names=["_first", "_rows", "_sources"])


def size_segments(sources: DataFrame, secs: float = 10.0, fps: float = 30.0) -> DataFrame:
    """Ranges estimated from a file size (asset_id, size_bytes) at 5 MiB a second.

    A source has as many rows as its size asks for, so runs of up to SEGMENTS_PER_RUN of them are dealt out over the tasks
    first: neither one very large source nor large ones that lie together are one task. Sources with the same run in a task
    get its segments in turn, so that a table holds numbers and times of a segment once for all of them.
    """
    lasted = F.col("size_bytes").cast("double") / F.lit(float(BYTES_PER_SECOND))
    count = F.greatest(F.ceil(lasted / F.lit(float(secs))), F.lit(1)).cast("bigint")
    frames = math.floor(secs * fps)
    run = F.lit(SEGMENTS_PER_RUN).cast("bigint")
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1, run)
    runs = sources.select("asset_id", lasted.alias("_lasted"), count.alias("_count")).withColumn("_first", F.explode(firsts))
    # a number of partitions of its own: few bytes become very many rows
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.select("asset_id", "_lasted", "_first", F.least(run, F.col("_count") - F.col("_first")).alias("_rows")).repartition(
        parts, F.xxhash64("asset_id", "_first")
    )
    held = T.ArrayType(T.StructType([sources.schema["asset_id"], T.StructField("_lasted", T.DoubleType())]))
    run_type = T.StructType([T.StructField("_first", T.LongType()), T.StructField("_rows", T.LongType()), T.StructField("_sources", held)])
    together = dealt.sortWithinPartitions("_first", "_rows").mapInArrow(_together, run_type)
    each = together.select("_sources", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_rows") - 1)).alias("segment_id"))
    # generated code keeps all rows that come of one of its input rows: coalesce, which moves nothing here, ends it
    return each.coalesce(parts).select(F.inline("_sources"), "segment_id").select(
        "asset_id", "segment_id",
        (F.col("segment_id") * frames).alias("start_frame"),
        ((F.col("segment_id") + 1) * frames).alias("end_frame"),
        (F.col("segment_id") * F.lit(float(secs))).alias("start_ts"),
        F.least((F.col("segment_id") + 1) * F.lit(float(secs)), F.col("_lasted")).alias("end_ts"),
        F.lit(0.5).alias("complexity_estimate"),
    )


def frames_of_segments(segments: DataFrame, frames: DataFrame, bucket_frames: int = BUCKET_FRAMES) -> DataFrame:
    """Frames(asset_id, frame_idx, ...) with the segment whose inclusive frame range holds them.

    Frame numbers are unique per asset, so a bucket of frames is bounded and needs no salt.
    """
    spans = segments.select("asset_id", "segment_id", "start_frame", "end_frame")
    inside = F.col("frame_idx").between(F.col("start_frame"), F.col("end_frame"))
    return point_join(
        frames, spans, ["asset_id"], F.col("frame_idx"), (F.col("start_frame"), F.col("end_frame")),
        bucket_frames, inside, rows_per_task=None,
    )


def frames_in_segments(segments: DataFrame, frames: DataFrame, bucket_frames: int = BUCKET_FRAMES) -> DataFrame:
    """Segments with mean complexity (0.0 without frames) and the number of scene changes.

    The scene changes themselves are rows of ``scene_changes_in_segments``, not an array per segment.
    """
    measured = (
        frames_of_segments(segments, frames, bucket_frames)
        .groupBy("asset_id", "segment_id")
        .agg(F.avg("complexity").alias("_mean"), F.count_if("is_scene_change").alias("_changes"))
    )
    return segments.join(measured, ["asset_id", "segment_id"], "left").select(
        *segments.columns,
        F.coalesce("_mean", F.lit(0.0)).alias("complexity_estimate"),
        F.coalesce("_changes", F.lit(0)).cast("bigint").alias("scene_change_count"),
    )


def scene_changes_in_segments(
    segments: DataFrame, frames: DataFrame, bucket_frames: int = BUCKET_FRAMES
) -> DataFrame:
    """(asset_id, segment_id, frame_idx) of each scene change inside a segment."""
    changes = frames.where(F.col("is_scene_change")).select("asset_id", "frame_idx")
    return frames_of_segments(segments, changes, bucket_frames).select("asset_id", "segment_id", "frame_idx")


def hardest_segments(segments: DataFrame, n: int) -> DataFrame:
    """The n most complex segments of the whole table, ties by job and segment."""
    order = [F.col("complexity_estimate").desc(), F.col("job_id"), F.col("segment_id")]
    return segments.orderBy(*order).limit(n)


def hardest_segments_per_job(segments: DataFrame, n: int) -> DataFrame:
    """The n most complex segments of each job, ranked, for any n without a window over all of a job's segments."""
    return slices.first_of_group(segments, ["job_id"], [F.col("complexity_estimate").desc(), F.col("segment_id")], n, "rank")


def max_segment_duration(segments: DataFrame) -> DataFrame:
    """(asset_id, target_duration): the longest segment, rounded up to whole seconds."""
    longest = F.greatest(F.max(F.col("end_ts") - F.col("start_ts")), F.lit(0.0))
    return segments.groupBy("asset_id").agg(F.ceil(longest).cast("bigint").alias("target_duration"))
