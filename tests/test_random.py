"""Sliced, bucketed and salted forms against plain Python on random tables, with slices small enough to matter."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gopmill.operators import capacity, decisions, frames, gops, health, jobs, packets, rangejoin, segments, slices


def random_assets(rng, count):
    """(fps, total, keyframes) per asset; keyframes start anywhere and may end on the last frame."""
    out = {}
    for asset in range(count):
        total = rng.choice([1, 5, 40, 200, 600])
        density = rng.choice([0.02, 0.1, 0.5, 1.0])
        keys = [f for f in range(total) if rng.random() < density] or [0]
        if rng.random() < 0.7:
            keys = sorted({0, *keys})
        if rng.random() < 0.3:
            keys = sorted({*keys, total - 1})
        out[asset] = (rng.choice([1.0, 5.0, 7.5]), total, keys)
    return out


def cut_plainly(fps, total, keys, target):
    """(start, end) frames by walking from keyframe to keyframe."""
    span = int(target * fps + 0.5)
    last, at, out = len(keys) - 1, 0, []
    while True:
        goal = keys[at] + span
        if goal < total:
            nearest = min(range(len(keys)), key=lambda i: (abs(keys[i] - goal), i))
            follower = max(nearest, at + 1)
        if goal >= total or follower > last:
            if not (at == last and at > 0 and total - 1 <= keys[at]):
                out.append((keys[at], total - 1))
            return out
        out.append((keys[at], keys[follower] - 1))
        at = follower


@pytest.mark.parametrize("blocks,slice_rows", [((), 1 << 16), ((16, 64), 32), ((7,), 5)])
def test_segments(table, blocks, slice_rows):
    rng = random.Random(11)
    assets = random_assets(rng, 60)
    media = table(
        [(a, fps, total, total / fps) for a, (fps, total, _) in assets.items()],
        "asset_id bigint, fps double, total_frames bigint, duration_secs double",
    )
    keys = table(
        [(a, i, f, f / fps) for a, (fps, _, ks) in assets.items() for i, f in enumerate(ks)],
        "asset_id bigint, kf_idx bigint, frame_idx bigint, ts double",
    )
    got = {}
    for r in segments.create_segments(media, keys, 4.0, slice_rows=slice_rows, blocks=blocks).collect():
        got.setdefault(r.asset_id, {})[r.segment_id] = r
    for asset, (fps, total, ks) in assets.items():
        mine = got.get(asset, {})
        assert sorted(mine) == list(range(len(mine)))
        assert [(mine[i].start_frame, mine[i].end_frame) for i in sorted(mine)] == cut_plainly(fps, total, ks, 4.0)
        for r in mine.values():
            assert r.start_ts == r.start_frame / fps
            assert r.end_ts == pytest.approx((r.end_frame + 1) / fps)


def test_gops_and_slices(table):
    rng = random.Random(5)
    rows = [
        (a, i, i / 25.0 + (rng.random() - 0.5) / 10, rng.randrange(1000), "K__" if rng.random() < 0.1 else "___")
        for a in range(4) for i in range(rng.randrange(1, 120))
    ]
    rng.shuffle(rows)
    made = table(rows, "asset_id bigint, packet_idx bigint, pts_time double, size_bytes bigint, flags string")
    small = sorted(map(tuple, gops.gop_stats(made, slice_rows=7).collect()))
    assert small == sorted(map(tuple, gops.gop_stats(made).collect()))
    assert sum(r[6] for r in small) == sum(r[3] for r in rows)
    want = {}
    for a, i, _, size, flags in sorted(rows):
        gop, total = want.get(a, [(0, [0])])[-1] if a in want else (0, None)
        if a not in want:
            want[a] = [(0, [0])]
        elif flags.startswith("K"):
            want[a].append((gop + 1, [0]))
        want[a][-1][1][0] += size
    assert {(r[0], r[1]): r[6] for r in small} == {(a, g): t[0] for a, gs in want.items() for g, t in gs}


def test_neighbours_and_running_values(table):
    rng = random.Random(3)
    rows = [(k, p, rng.randrange(100)) for k in range(3) for p in rng.sample(range(400), 90)]
    made = table(rows, "k int, p bigint, v bigint")
    whole = Window.partitionBy("k").orderBy("p")
    want = made.select(
        "k", "p", F.lag("v").over(whole), F.lead("p").over(whole), F.sum("v").over(whole.rowsBetween(Window.unboundedPreceding, 0)),
        F.row_number().over(whole),
    )
    got = slices.previous(made, ["k"], slices.slice_of("p", 16), ["p"], {"v": "was"})
    got = slices.following(got, ["k"], slices.slice_of("p", 16), ["p"], {"p": "next"})
    got = slices.running_sum(got, ["k"], slices.slice_of("p", 16), ["p"], F.col("v"), "total")
    got = slices.row_number(got, ["k"], slices.slice_of("p", 16), ["p"], "n")
    assert sorted(map(str, got.select("k", "p", "was", "next", "total", "n").collect())) == sorted(
        map(str, want.toDF("k", "p", "was", "next", "total", "n").collect())
    )


def test_assignment(table):
    rng = random.Random(8)
    for _ in range(2):
        segs = [(j, s, rng.choice([0.1, 0.5, 0.5, 0.9])) for j in range(5) for s in range(rng.randrange(0, 40))]
        nodes = [
            (n, rng.randrange(1, 9), rng.randrange(1, 6), rng.randrange(0, 6), rng.choice(["Active", "Active", "Busy", "Dead"]))
            for n in range(15)
        ]
        free = {n: max(most - active, 0) for n, _, most, active, status in nodes if status == "Active"}
        order = sorted((n for n in free if free[n]), key=lambda n: (-free[n] * nodes[n][1], n))
        want = {}
        for job, seg, _ in sorted(segs, key=lambda s: (s[0], -s[2], s[1])):
            node = next((n for n in order if free[n] > 0), None)
            if node is not None:
                free[node] -= 1
                want[job, seg] = node
        made = table(segs, "job_id int, segment_id int, complexity_estimate double")
        fleet = table(nodes, "node_id int, cpu_cores int, max_concurrent_workers int, active_workers int, status string")
        got = {(r.job_id, r.segment_id): r.node_id for r in capacity.assign_segments(made, fleet).collect()}
        assert got == want
    ranks = {(r.job_id, r.segment_id): r.priority for r in capacity.priority_rank(made).collect()}
    for job in {s[0] for s in segs}:
        mine = sorted((s for s in segs if s[0] == job), key=lambda s: (-s[2], s[1]))
        assert [ranks[job, s[1]] for s in mine] == list(range(1, len(mine) + 1))


def test_an_asset_of_keyframes_only(spark):
    """Every frame a keyframe and long segments: as many ways into a block as a segment has frames, and still one row each."""
    total, fps, target = 60_000, 25.0, 250.0
    keys = spark.range(total).selectExpr("1L AS asset_id", "id AS kf_idx", "id AS frame_idx", f"id / {fps}D AS ts")
    media = spark.createDataFrame([(1, fps, total, total / fps)], "asset_id bigint, fps double, total_frames bigint, duration_secs double")
    got = sorted(tuple(r)[1:4] for r in segments.create_segments(media, keys, target, blocks=(1 << 12, 1 << 14)).collect())
    span = int(target * fps)
    assert got == [(n, at, min(at + span, total) - 1) for n, at in enumerate(range(0, total, span))]


def test_chains_of_many_ways_in(table):
    """Walks of random forward links, whatever the blocks, visit what a plain walk visits."""
    rng = random.Random(31)
    links, want = [], []
    for asset in range(12):
        frames = sorted(rng.sample(range(3000), rng.randrange(1, 400)))
        to = {f: rng.choice([None, *frames[i + 1 : i + 30]]) if rng.random() < 0.02 else (rng.choice(frames[i + 1 : i + 30]) if i + 1 < len(frames) else None) for i, f in enumerate(frames)}
        links += [(asset, f, t) for f, t in to.items()]
        at = frames[0]
        while at is not None:
            want.append((asset, at))
            at = to[at]
    made = table(links, "asset_id bigint, frame bigint, to bigint")
    entries = made.groupBy("asset_id").agg(F.min("frame").alias("frame"))
    for blocks in ((), (50,), (16, 300), (4, 40, 400)):
        got = segments.visited_keyframes(made, entries, blocks)
        assert sorted(map(tuple, got.collect())) == sorted(want), blocks


LINES = [
    "INFO Analyzing video", "Created {n} segments", "segments without a number", "pre-split", "presplit_1", "now splitting", "segment_0001",
    "Transcoding", "encoding frame", "writing playlist", "concatenating", "Assembling", "Pipeline complete:", "Segment {n} done: 3 frames",
    "segment {n} DONE", "Segment {n} donee", "noise", "Transcoding {n} segments with 4 workers", "Created 0 segments", "Segment {n} done, encoding",
]


def fold_phase(lines):
    """Line by line, as a job's record would change."""
    import re

    phase, percent, total, done, out = "starting", 0, 0, 0, []
    for line in lines:
        low = line.lower()
        found = re.search(r"created\s+(\d+)\s+segments", low)
        if found and int(found[1]) > 0:
            total = int(found[1])
        if re.search(r"segment\s+\d+\s+done\b", low):
            done += 1
            if total and done > total:
                done = total
        if "analyzing" in low:
            phase, percent = "analyzing", 10
        elif "segments" in low:
            if re.search(r"\d+\s+segments", low):
                phase, percent = "splitting", 25
        elif any(w in low for w in ("pre-split", "presplit_", "splitting")):
            phase, percent = "splitting", 30
        elif any(w in low for w in ("segment_", "transcoding", "encoding")):
            phase = "encoding"
            percent = max(percent, 40 + int(min(1, done / total) * 45 + 0.5) if total else 40)
        elif any(w in low for w in ("playlist", "concatenat", "assembling")):
            phase, percent = "finalizing", 90
        elif "pipeline complete" in low:
            phase, percent = "complete", 100
        out.append((phase, percent, total, done))
    return out


def random_logs(rng, count):
    """{job: lines}; some jobs hold only noise, done lines and encoding lines."""
    calm = [LINES[i] for i in (6, 7, 8, 13, 14, 16, 19)]
    return {
        job: [rng.choice(calm if job % 3 == 0 and rng.random() < 0.9 else LINES).format(n=rng.randrange(1, 9)) for _ in range(rng.randrange(1, 70))]
        for job in range(count)
    }


@pytest.mark.parametrize("slice_rows", [4, 1 << 16])
def test_log_phase(table, slice_rows):
    logs = random_logs(random.Random(21), 120)
    rows = [(job, seq, line) for job, lines in logs.items() for seq, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    got = jobs.log_phase(table(rows, "job_id bigint, seq bigint, line string"), slice_rows)
    found = {(r.job_id, r.seq): (r.phase, r.percent, r.segments_total, r.segments_done) for r in got.collect()}
    for job, lines in logs.items():
        assert [found[job, i] for i in range(len(lines))] == fold_phase(lines), job


@pytest.mark.parametrize("rows_per_task", [None, 3])
def test_overlaps(table, rows_per_task):
    """Zero-length and reversed intervals included."""
    rng = random.Random(2)

    def spans(n, most):
        out = []
        for i in range(n):
            start = rng.choice([0.0, 10.0, rng.uniform(0, 60)])
            out.append((i % 3, i, start, start + rng.choice([0.0, -3.0, rng.uniform(0, most)])))
        return out

    many, few = spans(150, 30), spans(20, 25)
    left = table([(*s, 1.0) for s in many], "asset_id bigint, gop_idx bigint, start_time double, end_time double, bitrate_bps double")
    right = table(few, "asset_id bigint, segment_id bigint, start_ts double, end_ts double")
    got = decisions.gops_in_ranges(right, left, width=4.0, rows_per_task=rows_per_task).select("gop_idx", "segment_id").collect()
    want = sorted((g[1], r[1]) for g in many for r in few if g[0] == r[0] and g[2] < r[3] and g[3] > r[2])
    assert sorted(map(tuple, got)) == want


FAR = [9.2e10, -9.2e10, 1e300, -1e300, float("inf"), float("nan"), 700.0, 5e4, 3e7]


@pytest.mark.parametrize("seed", range(6))
def test_overlaps_of_any_length(table, seed):
    """Lengths from nothing to beyond all numbers, on both sides: the same pairs as comparing all."""
    rng = random.Random(seed)

    def spans(n):
        out = []
        for i in range(n):
            start = rng.choice([0.0, rng.uniform(-50, 900), rng.uniform(0, 10.0 ** rng.randrange(1, 12))])
            end = rng.choice([start, start + rng.uniform(-5, 30), start + 10.0 ** rng.uniform(0, 12), rng.choice(FAR)])
            out.append((i % 3, i, *rng.choice([(start, end), (end, start), (start, end)])))
        out += [(0, n, None, 5.0), (1, n + 1, None, None)]
        return out

    many, few = spans(120), spans(40)
    left = table([(*s, 1.0) for s in many], "asset_id bigint, gop_idx bigint, start_time double, end_time double, bitrate_bps double")
    right = table(few, "asset_id bigint, segment_id bigint, start_ts double, end_ts double")
    got = decisions.gops_in_ranges(right, left, width=4.0).select("gop_idx", "segment_id").collect()
    pairs = left.join(right, "asset_id").where("start_time < end_ts AND end_time > start_ts")
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs.select("gop_idx", "segment_id").collect()))


def test_points_in_intervals_of_any_length(table):
    rng = random.Random(8)
    points = [(i % 2, i, rng.choice([rng.uniform(-20, 500), 10.0 ** rng.uniform(0, 13)])) for i in range(200)]
    spans = [(i % 2, i, a := rng.uniform(-20, 500), a + rng.choice([0.0, 3.0, 10.0 ** rng.uniform(0, 13), float("inf")])) for i in range(60)]
    left, right = table(points, "k int, p int, at double"), table(spans, "k int, s int, low double, high double")
    inside = F.col("at").between(F.col("low"), F.col("high"))
    got = rangejoin.point_join(left, right, ["k"], F.col("at"), (F.col("low"), F.col("high")), 2.0, inside, None)
    want = left.join(right, "k").where(inside)
    assert sorted(map(tuple, got.select("p", "s").collect())) == sorted(map(tuple, want.select("p", "s").collect()))


def test_a_long_interval_is_a_few_rows(spark):
    """A span of 9.2e10 s does not cost more than a short one, and short ones cost nothing for it beyond two rows."""
    gops_of = spark.range(20_000).selectExpr(
        "id % 50 AS asset_id", "id AS gop_idx", "id * 1.0D AS start_time", "IF(id = 7, 9.2e10D, id + 2.0D) AS end_time", "1.0D AS bitrate_bps"
    )
    spans = spark.range(300).selectExpr("id % 50 AS asset_id", "id AS segment_id", "id * 60.0D AS start_ts", "IF(id = 9, 9.2e10D, id * 60.0D + 9) AS end_ts")
    for df, columns, other in ((gops_of, ("start_time", "end_time"), spans), (spans, ("start_ts", "end_ts"), gops_of)):
        span = rangejoin._Span(*[F.col(c) for c in columns], 10.0)
        alone = df.select(F.size(span.cells(span.level)).alias("n"))
        assert alone.agg(F.max("n")).first()[0] <= rangejoin.CELLS + 1
        across = rangejoin._Span(*[F.col(c) for c in other.columns[-2:]], 10.0) if other is spans else rangejoin._Span(F.col("start_time"), F.col("end_time"), 10.0)
        both = rangejoin._listed(df, span, rangejoin._levels(other, across)).groupBy(*df.columns).count()
        assert both.agg(F.max("count")).first()[0] <= rangejoin.CELLS + 3
    began = time.time()
    got = decisions.gops_in_ranges(spans, gops_of).count()
    assert time.time() - began < 20
    assert got == gops_of.join(spans, "asset_id").where("start_time < end_ts AND end_time > start_ts").count()


@pytest.mark.parametrize("kind", ["video", "audio"])
def test_packets_of_segments(table, kind):
    rng = random.Random(4)
    rows = [(a, i, rng.choice([None, -0.5, 0.0, rng.uniform(0, 50)])) for a in range(3) for i in range(80)]
    spans = [(a, s, s * 9.0 + (0.05 if s == 0 else 0), s * 9.0 + 9) for a in range(3) for s in range(5)]
    got = packets.packets_in_segments(
        table(rows, "asset_id bigint, packet_idx bigint, pts_time double"),
        table(spans, "asset_id bigint, segment_id bigint, start_ts double, end_ts double"),
        kind, width=4.0, rows_per_task=5,
    )
    want = []
    for a, i, t in rows:
        if kind == "audio" and t is None:
            want.append((a, i, None))
            continue
        at = 0.0 if t is None else t
        for b, s, start, end in spans:
            if a == b and at <= end + 0.001 and (at >= start - 0.001 or (kind == "video" and start < 0.1)):
                want.append((a, i, s))
    assert sorted(map(str, ((r.asset_id, r.packet_idx, r.segment_id) for r in got.collect()))) == sorted(map(str, want))


def test_hot_keys_are_split_without_loss(table):
    big = table([(1 if i % 3 else i, i) for i in range(300)], "k bigint, v bigint")
    small = table([(i, i * 10) for i in range(300)], "k bigint, w bigint")
    dealt, repeated, on = rangejoin.spread_hot(big, small, ["k"], rows_per_task=20)
    assert dealt.where("k = 1").select("_salt").distinct().count() > 5
    got = sorted(map(tuple, dealt.join(repeated, on).select("k", "v", "w").collect()))
    assert got == sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))


def test_cells_of_many_pairs_are_split(table, monkeypatch):
    """Long intervals and all that lies in them meet in one cell: it is dealt out by pairs, and pairs know their cell."""
    monkeypatch.setattr(rangejoin, "PAIRS_PER_TASK", 100)
    gop = table([(1, g, g * 2.0 - 50, g * 2.0 - 48) for g in range(200)] + [(None, 0, 0.0, 1.0)], "k int, gop int, low double, high double")
    spans = table([(1, s, s * 7.0 - 40, 9.2e10 if s % 2 else s * 7.0 + 13) for s in range(20)] * 2, "k int, span int, start double, end double")
    overlap = (F.col("low") < F.col("end")) & (F.col("high") > F.col("start"))
    met = rangejoin.overlap_join(gop, spans, ["k"], ("low", "high"), ("start", "end"), 10.0, overlap)
    want = gop.join(spans, "k").where(overlap).select("k", "gop", "span")
    assert sorted(map(tuple, met.select("k", "gop", "span").collect())) == sorted(map(tuple, want.collect()))
    dealt, repeated, on = rangejoin._spread_pairs(gop, spans, ["k"], 1000)
    assert dealt.where("k = 1").select("_salt").distinct().count() > 20
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert not [line for line in joins if "LOG2" in line.upper() or "POW" in line.upper()]


def test_untimed_audio_comes_in_runs(table, monkeypatch):
    """Every packet with every segment; a packet's segments come in runs, those of one run packet by packet."""
    for name, size in (("PACKETS_PER_BLOCK", 16), ("SEGMENTS_PER_BLOCK", 8), ("SEGMENTS_PER_RUN", 4)):
        monkeypatch.setattr(packets, name, size)
    sound = [(a, i, None if i % 3 else 1.0, f"{a}") for a in (1, 2) for i in range(47)] + [(None, 1, None, "x"), (2, 4, None, None), (1, None, None, "y"), (9, 1, None, "z")]
    cut = [(a, s) for a in (1, 2, 7, None) for s in range(11)] + [(1, 3), (2, None)]
    timed = table(sound, "asset_id int, packet_idx int, pts_time double, note string")
    cuts = table(cut, "asset_id int, segment_id int")
    got = packets.untimed_audio_in_segments(timed, cuts)
    assert got.columns == ["asset_id", "packet_idx", "pts_time", "note", "segment_id"]
    want = [(*p, s) for p in sound for a, s in cut if p[2] is None and p[0] is not None and p[0] == a]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    longest, run = 0, 0
    for before, row in zip([None, *rows], rows, strict=False):
        run = run + 1 if before and before[:4] == row[:4] and row[1] is not None else 1
        longest = max(longest, run)
    assert longest < 11


def test_segments_of_sources_come_in_turn(table, monkeypatch):
    """Every source has its segments; sources with the same run get them segment by segment, at most so many at once."""
    monkeypatch.setattr(segments, "SEGMENTS_PER_RUN", 8)
    span = 10 * segments.BYTES_PER_SECOND
    sizes = [(f"a{i}", (3 + i % 2 * 18) * span - 7) for i in range(600)] + [("a1", 5 * span), ("a1", 5 * span), (None, span), ("none", 0), ("unknown", None)]
    got = [tuple(r) for r in segments.size_segments(table(sizes, "asset_id string, size_bytes bigint")).collect()]
    want = []
    for asset, size in sizes:
        lasted = None if size is None else size / segments.BYTES_PER_SECOND
        for s in range(max(-(-(size or 0) // span), 1)):
            end = (s + 1) * 10.0
            want.append((asset, s, s * 300, (s + 1) * 300, s * 10.0, end if lasted is None else min(end, lasted), 0.5))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(a[1] != b[1] for a, b in zip(got, got[1:], strict=False)) < len(got) / 5


def test_one_job_fills_many_slices(table):
    """Equal complexities of a single job still spread over the range partitions."""
    made = table([(1, s, 0.5) for s in range(2000)], "job_id int, segment_id int, complexity_estimate double")
    ranged = slices.range_slices(made, capacity.pending_order(), 8)
    sizes = [r["count"] for r in ranged.groupBy(slices.SLICE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 800
    ranks = slices.global_rank(made, capacity.pending_order(), "r", 8).where(F.col("r") != F.col("segment_id") + 1)
    assert ranks.count() == 0


def test_one_target_asked_for_often(table):
    keys = table([(1, i, i * 100, i * 4.0) for i in range(5)], "asset_id bigint, kf_idx bigint, frame_idx bigint, ts double")
    wanted = table([(1, 160 if i % 3 else i, i) for i in range(120)], "asset_id bigint, target_frame bigint, row_id int")
    got = segments.nearest_keyframe(wanted, keys, rows_per_task=10).collect()
    assert len(got) == 120 and all(r.kf_idx == 2 for r in got if r.target_frame == 160)


def test_scene_changes_across_slices(table):
    rng = random.Random(6)
    rows = [(a, f, [rng.random() for _ in range(4)], 0.1) for a in range(3) for f in rng.sample(range(100), 40)]
    made = table(rows, "asset_id bigint, frame_idx bigint, histogram array<double>, complexity double")
    got = sorted(map(tuple, frames.scene_changes(made, 0.1, slice_rows=8).collect()))
    assert got == sorted(map(tuple, frames.scene_changes(made, 0.1).collect()))
    assert sum(r[3] is None for r in got) == 3


def test_latest_status_follows_every_beat(table):
    rng = random.Random(13)
    nodes = [(n, rng.choice(["Joining", "Active", "Busy", "Draining", "Dead"])) for n in range(40)]
    beats, want = [], {}
    for node, status in nodes:
        at, last = 0, None
        for _ in range(rng.randrange(0, 5)):
            at += rng.choice([3, 5, 25])
            if last is not None and at - last > 10:
                status = "Dead"
            load = rng.choice([1, 4])
            if load >= 4:
                status = "Busy"
            elif status in ("Busy", "Dead"):
                status = "Active"
            beats.append((node, at, load, 4))
            last = at
        if last is not None and 130 - last > 10:
            status = "Dead"
        want[node] = status
    made = table(beats, "node_id int, at bigint, active_workers int, max_concurrent_workers int").withColumn("ts", F.timestamp_seconds("at"))
    got = health.latest_status(made, table(nodes, "node_id int, status string"), F.timestamp_seconds(F.lit(130)))
    assert {r.node_id: r.status for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_few_segments_are_ranked_for_few_slots(table, seed):
    """Of the job in which the slots run out only its first segments are ranked, ties among them too."""
    rng = random.Random(seed)
    shape = [lambda: rng.random(), lambda: 0.5, lambda: rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]), lambda: rng.choice([None, 0.3, rng.random()])][seed]
    segs = [(1, s, shape()) for s in range(40)] + [(2, s, shape()) for s in range(9000)] + [(3, s, 0.9) for s in range(50)]
    rng.shuffle(segs)
    nodes = [(n, 8, 20, 0, "Active") for n in range(5)]
    made = table(segs, "job_id int, segment_id int, complexity_estimate double").repartition(6)
    fleet = table(nodes, "node_id int, cpu_cores int, max_concurrent_workers int, active_workers int, status string")
    order = sorted(segs, key=lambda s: (s[0], s[2] is None, -(s[2] or 0), s[1]))[:100]
    got = capacity.assign_segments(made, fleet).collect()
    assert {(r.job_id, r.segment_id): r.slot_rank for r in got} == {(j, s): i + 1 for i, (j, s, _) in enumerate(order)}
    ranked = capacity._reachable(made, capacity.node_slot_ranges(fleet)).count()
    assert 100 <= ranked <= 100 + 3 * 9000 // capacity.CELLS


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows_of_a_group(table, n):
    rng = random.Random(n)
    rows = [(j, s, rng.choice([0.1, 0.2, rng.random()])) for j in range(3) for s in range(4000 if j == 1 else 20)]
    got = segments.hardest_segments_per_job(table(rows, "job_id int, segment_id int, complexity_estimate double"), n)
    want = []
    for job in range(3):
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (-r[2], r[1]))[:n]
        want += [(job, s, c, i + 1) for i, (_, s, c) in enumerate(mine)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    lines = table([(1, s, "x") for s in range(5000)], "job_id int, seq bigint, line string")
    assert sorted(r.seq for r in jobs.retained_logs(lines, n).collect()) == list(range(5000 - n, 5000))
