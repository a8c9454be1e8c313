"""Rules on hand-made rows."""

import ipaddress
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from gopmill.functions import encode, net, pods, requests, text, timing
from gopmill.operators import access, capacity, decisions, frames, gops, health, jobs, packets, segments, slices, texts
from gopmill.sources import messages, probe
from test_random import cut_plainly


def one(df):
    return [tuple(r) for r in df.collect()]


def values(table, column, rows, schema):
    return [r[0] for r in table(rows, schema).select(column).collect()]


# -- segmenting --------------------------------------------------------------------------------------------------

MEDIA = "asset_id bigint, fps double, total_frames bigint, duration_secs double"
KEYS = "asset_id bigint, kf_idx bigint, frame_idx bigint, ts double"


def keyframe_rows(frames_, fps=30.0, asset=1):
    return [(asset, i, f, f / fps) for i, f in enumerate(frames_)]


def cut(table, frames_, total, target=10.0, fps=30.0, **options):
    media = table([(1, fps, total, total / fps)], MEDIA)
    rows = segments.create_segments(media, table(keyframe_rows(frames_, fps), KEYS), target, **options).orderBy("segment_id")
    return [(r.start_frame, r.end_frame) for r in rows.collect()]


def test_segments_start_on_keyframes_and_cover(table):
    keys = [0, 37, 91, 260, 333, 512, 640, 655]
    for total in (656, 700, 1200):
        for target in (2.0, 6.5, 40.0):
            got = cut(table, keys, total, target, fps=24.0)
            assert got == cut_plainly(24.0, total, keys, target)
            assert got[0][0] == 0 and all(b[0] == a[1] + 1 and b[0] in keys for a, b in itertools.pairwise(got))


def test_single_keyframe_gives_one_segment(table):
    assert cut(table, [0], 77) == [(0, 76)]


def test_last_keyframe_on_last_frame_is_lost_unless_kept(table):
    keys = [0, 240, 480]
    assert cut(table, keys, 481, 10.0, 24.0) == [(0, 239), (240, 479)]
    assert cut(table, keys, 481, 10.0, 24.0, keep_tail=True) == [(0, 239), (240, 479), (480, 480)]


def test_assets_that_cannot_be_cut_are_rejected(table):
    media = table([(1, 25.0, 0, 0.0), (2, 25.0, 80, 3.2), (3, 0.002, 80, 3.2), (4, 25.0, 80, 3.2)], MEDIA)
    keys = table(keyframe_rows([0], asset=1) + keyframe_rows([0], asset=3) + keyframe_rows([0], asset=4), KEYS)
    got = dict(one(segments.segment_rejects(media, keys)))
    assert got == {
        1: "Video has no frames to segment", 2: "No keyframes detected",
        3: "Target segment duration too small for video frame rate",
    }
    assert one(segments.create_segments(media, keys).select("asset_id").distinct()) == [(4,)]


def test_nearest_keyframe_clamps_and_breaks_ties_early(table):
    frames_ = [3, 11, 29, 31, 60, 62]
    wanted = list(range(0, 80))
    targets = table([(1, t) for t in wanted], "asset_id bigint, target_frame bigint")
    got = {r.target_frame: r.kf_idx for r in segments.nearest_keyframe(targets, table(keyframe_rows(frames_), KEYS)).collect()}
    assert got == {t: min(range(len(frames_)), key=lambda i: (abs(frames_[i] - t), i)) for t in wanted}


def test_scene_changes_fall_into_their_segment(table):
    bounds = [(0, 0, 47), (1, 48, 111), (2, 112, 150)]
    spans = table([(1, *x) for x in bounds], "asset_id bigint, segment_id bigint, start_frame bigint, end_frame bigint")
    cuts = {5, 47, 48, 149}
    made = table([(1, f, f / 256, f in cuts) for f in range(151)], "asset_id bigint, frame_idx bigint, complexity double, is_scene_change boolean")
    got = segments.frames_in_segments(spans, made).orderBy("segment_id").collect()
    for r, (_, low, high) in zip(got, bounds, strict=True):
        assert r.complexity_estimate == pytest.approx(sum(range(low, high + 1)) / 256 / (high + 1 - low))
        assert r.scene_change_count == sum(low <= c <= high for c in cuts)
    assert sorted(one(segments.scene_changes_in_segments(spans, made))) == [(1, 0, 5), (1, 0, 47), (1, 1, 48), (1, 2, 149)]


# -- frames ------------------------------------------------------------------------------------------------------

PLANE = "asset_id bigint, frame_idx bigint, width int, height int, stride int, gray binary"


def test_binary_and_long_forms_agree(table):
    planes = {0: bytes([77] * 960), 1: bytes([0, 255] * 480), 2: bytes([3, 9, 200] * 320), 3: bytes(i * 7 % 256 for i in range(960))}
    binary = frames.frame_features(table([(1, f, 40, 24, 40, g) for f, g in planes.items()], PLANE))
    long = frames.features_from_pixels(
        table([(1, f, v) for f, g in planes.items() for v in g], "asset_id bigint, frame_idx bigint, gray int")
    )
    a = {r.frame_idx: r for r in binary.collect()}
    b = {r.frame_idx: r for r in long.collect()}
    for frame in planes:
        assert a[frame].histogram == b[frame].histogram
        assert a[frame].complexity == pytest.approx(b[frame].complexity, abs=1e-12)
        assert sum(a[frame].histogram) == pytest.approx(1.0)
    assert a[0].complexity == 0.0 and a[1].complexity == 1.0
    assert a[0].histogram[77 // 4] == 1.0


def test_stride_padding_and_empty_frames(table):
    padded = bytes([10, 10, 99, 10, 10])  # 2x2, stride 3, last row unpadded
    got = {r.frame_idx: r for r in frames.frame_features(table([(1, 0, 2, 2, 3, padded), (1, 1, 0, 0, 0, b"")], PLANE)).collect()}
    assert got[0].complexity == 0.0 and got[0].histogram[2] == 1.0
    assert got[1].complexity == 0.0 and math.isnan(got[1].histogram[0])


def test_short_plane_fails(table):
    with pytest.raises(Exception, match="shorter"):
        frames.frame_features(table([(1, 0, 4, 4, 4, b"abc")], PLANE)).collect()


def test_histogram_distance(table):
    flat = [1 / 64] * 64
    low, high = [1.0] + [0.0] * 63, [0.0] * 63 + [1.0]
    nothing = [float("nan")] * 64
    rows = [(flat, flat), (low, high), (nothing, low)]
    got = values(table, timing.histogram_distance(F.col("a"), F.col("b")), rows, "a array<double>, b array<double>")
    assert got == [0.0, 1.0, 0.0]


def test_pts_to_secs(table):
    rows = [(135000, 1, 90000), (7, 3, 4), (-30, 1, 12), (None, 1, 600)]
    got = values(table, timing.pts_to_secs(F.col("p"), F.col("n"), F.col("d")), rows, "p bigint, n int, d int")
    assert got == [0.0 if p is None else p * n / d for p, n, d in rows]


# -- GOPs and decisions -------------------------------------------------------------------------------------------

PACKETS = "asset_id bigint, packet_idx bigint, pts_time double, size_bytes bigint, flags string"


def test_gop_statistics(table):
    rows = [(1, i, i * 0.5, 100, "K__" if i in (0, 4) else "___") for i in range(6)] + [(2, 0, 3.0, 10, "K__")]
    got = gops.gop_stats(table(rows, PACKETS)).orderBy("asset_id", "gop_idx").collect()
    assert [(r.start_frame, r.end_frame, r.start_time, r.end_time, r.size_bytes) for r in got] == [
        (0, 3, 0.0, 1.5, 400), (4, 5, 2.0, 2.5, 200), (0, 0, 0.0, 3.0, 10),
    ]
    assert got[0].bitrate_bps == pytest.approx(400 * 8 / 1.5)
    later = gops.gop_stats(table(rows, PACKETS), first_start="packet").where("asset_id = 2").collect()[0]
    assert (later.start_time, later.bitrate_bps) == (3.0, 0.0)


def test_keyframe_zero_is_inserted_only_for_packets(table):
    rows = [(1, 0, 0.1, 1, "___"), (1, 1, 0.2, 1, "K__"), (1, 2, 0.3, 1, "k__")]
    made = table(rows, PACKETS)
    assert sorted(one(gops.keyframes(made))) == [(1, 0, 0, 0.0), (1, 1, 1, 0.2)]
    assert one(gops.keyframes(made, insert_zero=False)) == [(1, 0, 1, 0.2)]


MEDIA_ROW = (
    "asset_id bigint, width int, height int, fps double, duration_secs double, codec_name string, profile string, "
    "pix_fmt string, encoder string, crf int"
)
GOPS = "asset_id bigint, gop_idx bigint, start_time double, end_time double, bitrate_bps double"
TARGET = 8_000_000.0


def media_row(asset, encoder="libx264"):
    return (asset, 1920, 1080, 30.0, 20.0, "h264", "High", "yuv420p", encoder, 23)


def gop_rows(asset, rates):
    return [(asset, i, float(i), i + 1.0, rate) for i, rate in enumerate(rates)]


def test_recommendations(table):
    media = table([media_row(1, "libx265"), media_row(2), media_row(3), media_row(4)], MEDIA_ROW)
    rates = gop_rows(1, [TARGET] * 20) + gop_rows(2, [TARGET] * 20) + gop_rows(3, [TARGET] * 10 + [5 * TARGET] * 10)
    got = {r.asset_id: r for r in decisions.recommend(media, table(rates, GOPS), 0.3).collect()}
    assert got[1].mode == "normal" and got[1].reasons[0] == "re-encode everything: source codec h264 differs from target hevc"
    assert got[1].copyable_gop_fraction is None
    assert (got[2].mode, got[2].copyable_gop_fraction, got[2].preset) == ("copy", 1.0, "slow")
    assert got[2].reasons[-1] == "preset slow: about 0 min of 1080p30-equivalent work"
    assert (got[3].mode, got[3].copyable_gop_fraction) == ("smart-auto", 0.5)
    assert got[3].reasons[0] == "50% of GOPs near the target bitrate; copy those, re-encode the rest"
    assert (got[4].mode, got[4].reasons[0]) == ("normal", "no GOP bitrate data; re-encode everything")


def test_plan_honours_each_mode(table):
    media = table([media_row(1), media_row(2, "libx265")], MEDIA_ROW)
    rates = [TARGET] * 10 + [5 * TARGET] * 10
    gop_table = table(gop_rows(1, rates) + gop_rows(2, rates), GOPS)
    spans = table(
        [(a, s, s * 10.0, s * 10.0 + 10) for a in (1, 2) for s in (0, 1)],
        "asset_id bigint, segment_id bigint, start_ts double, end_ts double",
    )

    def copies(mode, asset=1):
        plan = decisions.plan_segments(media, spans, gop_table, mode, 0.3).where(F.col("asset_id") == asset)
        return [r.copy for r in plan.orderBy("segment_id").collect()]

    assert copies("normal") == [False, False] == copies("bogus")
    assert copies("copy") == [True, True]
    assert copies("smart") == [True, False] == copies("smart-auto")
    assert copies("smart", asset=2) == [False, False]


def test_tolerance_bound_below_the_minimum_is_refused(table):
    with pytest.raises(ValueError):
        gops.auto_tolerance(table([media_row(1)], MEDIA_ROW), table([], GOPS), 0.01)


def test_work_and_presets(table):
    rows = [(1280, 720, 25.0, d) for d in (10.0, 300.0, 330.0, 2400.0, 2500.0, 9000.0, 9800.0)] + [(640, 360, 50.0, 7.5), (-1, 5, 25.0, 10.0)]
    work = encode.work_units(F.col("w"), F.col("h"), F.col("f"), F.col("d"))
    got = one(table(rows, "w int, h int, f double, d double").select(encode.preset_for_work(work), work))
    for (w, h, f, d), (preset, units) in zip(rows, got, strict=True):
        want = max(w, 0) * h * f * d / (1920 * 1080 * 30)
        assert units == pytest.approx(want)
        # the steps are two, fifteen and sixty minutes of 1080p at 30 frames
        assert preset == ("slow" if want <= 120 else "medium" if want <= 900 else "fast" if want <= 3600 else "veryfast")


# -- names, requests, addresses ------------------------------------------------------------------------------------


def test_rationals(table):
    rows = [("30000/1001",), ("25",), ("x/2",), ("10/x",), ("1/0",), ("",), ("24/1/1",), (" 25",)]
    got = values(table, text.parse_rational(F.col("s")), rows, "s string")
    assert got == [30000 / 1001, 25.0, 15.0, 10.0, 30.0, 30.0, 24.0, 30.0]


def test_object_uris(table):
    rows = [("s3://my-bucket/jobs/abc/seg_0.ts",), ("srt://host:9910",), ("s3://bucket",), ("s3://bucket/",), ("s3:///key",)]
    got = values(table, text.parse_object_uri(F.col("u")), rows, "u string")
    assert tuple(got[0]) == ("my-bucket", "jobs/abc/seg_0.ts") and got[1:] == [None] * 4


def test_stored_names(table):
    rows = [("a/My clip (1).mp4", 5), (".hidden", 6), ("noext", 7)]
    got = values(table, text.safe_upload_name(F.col("n"), F.col("t")), rows, "n string, t bigint")
    assert got == ["My_clip__1__5.mp4", "_hidden_6", "noext_7"]
    urls = [("http://h/v/a b.mkv?x=1", 1), ("http://h/", 2), ("http://h/" + "x" * 300, 3)]
    got = values(table, text.safe_url_name(F.col("n"), F.col("t")), urls, "n string, t bigint")
    assert got[1] == "video_2.mp4" and got[2] == "x" * 200 + "_3.mp4"


def test_request_rules(table):
    schema = (
        "body boolean, uploadId string, format string, mode string, encoder string, preset string, crf double, workers double, "
        "smartTolerance double, verbose boolean"
    )
    good = dict(body=True, uploadId="u", format=None, mode=None, encoder=None, preset=None, crf=None, workers=None, smartTolerance=None, verbose=None)
    cases = [
        ({}, None), ({"body": False}, "body"), ({"uploadId": ""}, "uploadId"), ({"uploadId": None}, "uploadId"),
        ({"format": "avi"}, "format"), ({"mode": "turbo"}, "mode"), ({"encoder": "x"}, "encoder"), ({"preset": "13"}, "preset"),
        ({"preset": "12"}, None), ({"crf": 64.0}, "crf"), ({"crf": 1.5}, "crf"), ({"crf": 0.0}, None), ({"workers": 9.0}, "workers"),
        ({"smartTolerance": 0.04}, "smartTolerance"), ({"smartTolerance": float("nan")}, "smartTolerance"), ({"verbose": False}, "verbose"),
        ({"mode": "turbo", "crf": 99.0}, "mode"),
    ]
    cases += [({"encoder": e}, None) for e in requests.ENCODERS]
    made = table([tuple({**good, **change}.values()) for change, _ in cases], schema)
    columns = {c: F.col(c) for c in made.columns}
    verdicts = [r[0] for r in made.select(requests.validate_request(columns, max_workers=8)).collect()]
    assert [v and v["field"] for v in verdicts] == [want for _, want in cases]
    texts_ = {**columns, "crf": F.lit("23"), "workers": F.lit("abc")}
    assert [v[0].field for v in made.where("body and uploadId = 'u' and mode is null and encoder is null and preset is null and format is null").select(
        requests.validate_request(texts_)).collect()] == ["crf"] * sum(set(c) <= {"crf", "workers", "smartTolerance", "verbose"} for c, _ in cases)
    cluster = [r[0] for r in made.select(requests.validate_request(columns, cluster=True)).collect()]
    assert cluster[4]["error"] == "Cluster mode produces MP4 only" and cluster[12] is None


def test_addresses(table):
    v4 = ["8.8.4.4", "127.3.2.1", "10.0.0.7", "172.20.9.9", "172.40.0.3", "192.168.77.1", "192.169.0.1", "169.254.3.4", "100.100.1.1", "100.20.1.1", "0.1.2.3"]
    v6 = ["::1", "::2", "fc12::9", "fdab::1", "fe80:1::", "febf::1", "fec0::1", "2a00:1450::5", "1:2:3:4:5:6:7:8", "2a00::1%eth0"]
    none = ["words", "", "999.1.1.1", "08.2.3.4", "5.6.7", "::g", "1::2::3", "1:2:3", ":::", None]
    ranges = [ipaddress.ip_network(f"{base}/{bits}") for base, bits in net.BLOCKED_RANGES]
    free = lambda a: not any(a in r for r in ranges if r.version == a.version)
    cases = [(x, free(ipaddress.ip_address(x.split("%")[0]))) for x in v4 + v6] + [(x, False) for x in none]
    for x in v4:
        a, b, c, d = map(int, x.split("."))
        mapped = [f"::ffff:{x}", f"::FFFF:{a:02x}{b:02x}:{c:02x}{d:02x}", f"0:0:0:0:0:ffff:{x}", f"0000:0000:0000:0000:0000:ffff:{a:02X}{b:02X}:{c:02X}{d:02X}"]
        cases += [(m, free(ipaddress.ip_address(x))) for m in mapped]
    got = values(table, net.is_public_address(F.col("a")), [(a,) for a, _ in cases], "a string")
    assert got == [want for _, want in cases]


def test_url_schemes(table):
    rows = [("http://a/x",), ("HTTPS://a/x",), ("ftp://a/x",), ("not a url",), ("file:///etc",)]
    assert values(table, text.url_scheme_allowed(F.col("u")), rows, "u string") == [True, True, False, False, False]


def test_pods(spark, table):
    doc = """{"items": [
      {"metadata": {"name": "n-0", "labels": {"apps.kubernetes.io/pod-index": "0"}}, "spec": {"nodeName": "w"},
       "status": {"phase": "Running", "startTime": "2025-01-01T00:00:00Z", "containerStatuses": [{"ready": true, "restartCount": 1}]}},
      {"metadata": {"name": "n-1", "labels": {"apps.kubernetes.io/pod-index": "1"}}, "spec": {},
       "status": {"phase": "Pending", "containerStatuses": [{"ready": false, "restartCount": 0}, {"ready": true, "restartCount": 2}]}},
      {"metadata": {"name": "orphan"}, "status": {}, "spec": {}}]}"""
    got = one(pods.pod_summary(table([(doc,), ("{}",), (None,), ('{"items": null}',)], "json string")))
    assert got == [
        ("n-0", "Running", True, 1, "2025-01-01T00:00:00Z", "master", "0", "w"),
        ("n-1", "Pending", False, 2, None, "worker", "1", None),
        ("orphan", None, False, 0, None, "worker", None, None),
    ]


# -- capacity, jobs, health --------------------------------------------------------------------------------------

NODES = "node_id int, cpu_cores int, max_concurrent_workers int, active_workers int, status string"
SEGS = "job_id int, segment_id int, complexity_estimate double"


def assigned(table, segs, nodes):
    got = capacity.assign_segments(table(segs, SEGS), table(nodes, NODES))
    return {(r.job_id, r.segment_id): r.node_id for r in got.collect()}


def test_hardest_segments_go_to_the_strongest_node(table):
    got = assigned(table, [(1, 0, 0.9), (1, 1, 0.1)], [(1, 16, 1, 0, "Active"), (2, 2, 1, 0, "Active")])
    assert got == {(1, 0): 1, (1, 1): 2}


def test_full_busy_and_dead_nodes_take_nothing(table):
    nodes = [(1, 8, 2, 2, "Active"), (2, 8, 2, 0, "Busy"), (3, 8, 2, 0, "Dead"), (4, 4, 2, 1, "Active")]
    assert assigned(table, [(1, 0, 0.3), (1, 1, 0.7), (1, 2, 0.5)], nodes) == {(1, 1): 4}
    assert assigned(table, [(1, 0, 0.3)], nodes[:3]) == {}
    assert one(capacity.available_slots(table(nodes, NODES))) == [(3,)]


def test_progress_follows_the_latest_event(table):
    events = table(
        [(1, 0, 1, "assign"), (1, 0, 3, "failed"), (1, 0, 5, "complete"), (1, 1, 2, "assign"), (2, 0, 4, "failed")],
        "job_id int, segment_id int, seq bigint, kind string",
    )
    totals = table([(1, 3), (2, 1), (3, 2)], "job_id int, total bigint")
    got = jobs.job_progress(events, totals)
    assert sorted(one(got)) == [(1, 3, 1, 0, 1, 1), (2, 1, 0, 1, 0, 0), (3, 2, 0, 0, 0, 2)]
    states = {r.job_id: r for r in jobs.job_state(got).collect()}
    assert (states[1].state, states[2].state, states[2].message) == ("Processing", "Failed", "1 of 1 segments failed")


def test_requeued_segments_keep_their_descriptor(table):
    segs = table([(1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.4)], SEGS)
    latest = table([(1, 0, 7, "assign"), (1, 1, 8, "assign"), (1, 2, 7, "complete")], "job_id int, segment_id int, node_id int, kind string")
    dead = table([(7,)], "node_id int")
    assert one(capacity.requeue_from_dead(latest, dead, segs)) == [(1, 0, 0.9)]
    assert one(capacity.pending_segments(segs, latest.where("segment_id < 2"))) == [(1, 2, 0.4)]


def test_grants_are_spent_once_and_only_by_their_file(table):
    grants = table([("t", 1, "a.mp4", 0)], "ticket string, job_id int, filename string, at bigint")
    grants = grants.select("ticket", "job_id", "filename", F.timestamp_seconds("at").alias("issued_at"))
    tries = [(1, "t", 1, "b.mp4", 5), (2, "t", 2, "a.mp4", 6), (3, "t", 1, "a.mp4", 7), (4, "t", 1, "a.mp4", 8), (5, "u", 1, "a.mp4", 9)]
    made = table(tries, "attempt_id int, ticket string, job_id int, filename string, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.attempt_id: r.redeemed for r in access.redeem_grants(grants, made, rows_per_task=1).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}
    late = table([(9, "t", 1, "a.mp4", 60)], "attempt_id int, ticket string, job_id int, filename string, at bigint")
    late = late.withColumn("ts", F.timestamp_seconds("at"))
    assert not access.redeem_grants(grants, late).collect()[0].redeemed


def test_silence(table):
    beats = table([(1, 0), (1, 5), (1, 30), (2, 0), (3, 0)], "node_id int, at bigint").select("node_id", F.timestamp_seconds("at").alias("ts"))
    got = health.silent_intervals(beats, F.timestamp_seconds(F.lit(35)), 10, self_id=3)
    rows = got.select("node_id", F.unix_seconds("last_beat"), F.unix_seconds("dead_from"), F.unix_seconds("back_at"))
    assert sorted(one(rows)) == [(1, 5, 15, 30), (2, 0, 10, None)]


# -- packets, probes, messages, texts ------------------------------------------------------------------------------


def test_rebase_drops_what_lies_before_the_origin(table):
    made = table([(1, 0, 100, 90), (1, 0, 200, 190), (1, 0, None, 50)], "asset_id int, stream_index int, pts bigint, dts bigint")
    streams = table([(1, 0, 0.15, 1, 1000)], "asset_id int, stream_index int, origin_secs double, tb_num int, tb_den int")
    assert sorted(one(packets.rebased_packets(made, streams, rows_per_task=1)), key=str) == [(1, 0, 50, 40), (1, 0, None, -100)]


def test_audio_lead_takes_the_first_stream_of_a_kind(table):
    schema = "asset_id int, stream_index int, kind string, start_secs double"
    streams = table([(1, 0, "video", 1.4), (1, 1, "audio", 1.0), (1, 2, "audio", 0.0), (2, 0, "video", 1.0), (2, 1, "audio", None), (2, 2, "audio", 0.0), (3, 0, "audio", 0.0)], schema)
    got = {r.asset_id: r.lead_secs for r in packets.audio_lead(streams).collect()}
    assert got == {1: pytest.approx(0.4), 2: 0.0, 3: 0.0}


def test_probe_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"streams": [{"codec_type": "audio", "index": 1, "codec_name": "aac", "channels": 2, "sample_rate": "48000", "tags": {"language": "eng"},'
        ' "disposition": {"default": 1}}, {"codec_type": "video", "width": 320, "height": 240, "r_frame_rate": "25/1", "duration": "6.0"}],'
        ' "chapters": [{"id": 3, "time_base": "1/10", "start": 0, "end": 15, "tags": {"title": "one"}}]}'
    )
    (tmp_path / "b.json").write_text('{"streams": [{"codec_type": "video", "width": 320}]}')
    got = probe.read_probe_json(spark, str(tmp_path)).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.width, row.height, row.fps, row.duration_secs, row.total_frames, row.codec_name) == (320, 240, 25.0, 6.0, 150, "unknown")
    assert row.audio_tracks[0].language == "eng" and row.audio_tracks[0].is_default and row.chapters[0].end_secs == 1.5
    media = probe.read_probe_json(spark, str(tmp_path)).withColumn("asset_id", F.lit(1))
    assert texts.chapter_metadata(media).collect()[0].text == (
        ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1500\ntitle=one\n"
    )
    assert texts.hls_master(media).collect()[0].text == (
        '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",LANGUAGE="eng",NAME="eng",DEFAULT=YES,AUTOSELECT=YES\n'
        '#EXT-X-STREAM-INF:BANDWIDTH=0,AUDIO="audio"\nvideo.m3u8\n'
    )


def test_packet_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"packets": [{"pts_time": "0.5", "size": "7", "flags": "K_"}, {"pts_time": "x"}]}')
    got = probe.read_packets_json(spark, str(tmp_path)).select("packet_idx", "pts_time", "size_bytes", "flags")
    assert one(got) == [(0, 0.5, 7, "K_"), (1, 0.0, 0, "")]


def test_messages_default_missing_fields(table):
    raw = table(
        [('{"op": 30, "d": {"job_id": "j", "input_filename": "f", "input_size_bytes": 1, "config": {"crf": 23, "preset": "fast", "encoder": "libx264", "format": "mp4"}}}',),
         ('{"op": 40, "d": {"job_id": "j", "srt_url": "u", "segment": {"id": 1}, "encoding_config": {"crf": 1}}}',),
         ('{"op": 30, "d": {"job_id": "j"}}',), ("{",), ('{"op": 77, "d": {}}',)],
        "raw string",
    )
    parsed = messages.read_messages(raw)
    job = messages.payload_rows(parsed, "JobSubmit").collect()
    assert len(job) == 1 and (job[0].config.mode, job[0].config.smart_tolerance) == ("normal", 0.3)
    assert messages.payload_rows(parsed, "SegmentAssign").collect()[0].segment.copy is False
    assert messages.reject_rows(parsed).count() == 2
    assert parsed.where("op_name is null and not malformed").count() == 1


def test_lines_in_order_are_the_whole_text(table, tmp_path):
    spans = table([(1, s, s * 10.0, s * 10.0 + 9.5) for s in range(5)], "asset_id int, segment_id bigint, start_ts double, end_ts double")
    made = table([(1, s, f"/o/segment_{s:04d}.ts") for s in (4, 0, 1, 2, 3)], "asset_id int, segment_id bigint, output_path string")
    lines = texts.hls_playlist(made, spans)
    texts.write_lines(lines, str(tmp_path / "list"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*")))
    body = "".join(f"#EXTINF:9.500000,\nsegment_{s:04d}.ts\n" for s in range(5))
    assert whole == "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:10\n#EXT-X-MEDIA-SEQUENCE:0\n" + body + "#EXT-X-ENDLIST\n"
    assert texts.concat_list(made).orderBy("line_no").first().line == "file 'segment_0000.ts'"


def test_subtitles_of_one_language_keep_the_last(table):
    track = "array<struct<codec_name string, language string>>"
    made = table([([("srt", "eng"), ("ass", "eng"), ("pgs", "ger"), ("text", None)],)], f"t {track}")
    got = made.select(texts.subtitle_files(F.col("t")).alias("s")).collect()[0].s
    assert [(s.language, s.file) for s in got] == [("eng", "subs_eng.vtt"), ("und", "subs_und.vtt")]


def test_rows_without_key_or_position_stay(table):
    rows = [(1, 0, 0.0, 5, "K__"), (1, None, None, 5, "___"), (None, 0, 0.0, 5, "___")]
    numbered = gops.gop_ids(table(rows, "asset_id bigint, packet_idx bigint, pts_time double, size_bytes bigint, flags string"))
    assert numbered.count() == 3
    lines = table([(1, 1, "x"), (None, 2, "y"), (1, None, "z")], "job_id bigint, seq bigint, line string")
    assert jobs.log_phase(lines).count() == 3


def test_sparse_line_numbers_make_few_slices(table):
    rows = [(j, 1_000_000_007 * i, "x") for j in range(50) for i in range(40)] + [(99, 10**12 + 3 * i, "x") for i in range(1000)]
    sliced = slices.sliced_by_rows(table(rows, "job_id bigint, seq bigint, line string"), ["job_id"], "seq", 100)
    held = sliced.groupBy("job_id", slices.SLICE).count().collect()
    assert len(held) <= 50 + 10 and max(r["count"] for r in held) <= 100


def test_one_outlying_position_does_not_fill_a_slice(table):
    """Equal depths, not equal widths: however the positions lie, no slice holds twice the rows asked for."""
    import random

    rng = random.Random(3)
    schema = "job_id bigint, seq bigint"
    shapes = {
        1: [*range(9), 10**12],
        2: [*range(3000), 10**12, -(10**15)],
        3: sorted(rng.sample(range(10**15), 2500)),
        4: [int(1.02**i) + i for i in range(1500)],
        5: [i + 10**9 * (i // 700) for i in range(4000)],
        6: list(range(50)),
    }
    rows = [(job, seq) for job, seqs in shapes.items() for seq in seqs] + [(None, s) for s in range(500)] + [(7, None)] * 5
    for target in (2, 100):
        sliced = slices.sliced_by_rows(table(rows, schema), ["job_id"], "seq", target).collect()
        assert sorted(map(str, ((r.job_id, r.seq) for r in sliced))) == sorted(map(str, rows))
        held = {}
        for r in sliced:
            held.setdefault((r.job_id, r[slices.SLICE]), []).append(r.seq)
        assert max(len(x) for k, x in held.items() if k[0] != 7) <= 2 * target
        for job in shapes:  # slices are stretches of the order
            ends = [(min(x), max(x)) for (j, n), x in sorted(held.items(), key=str) if j == job]
            assert all(a[1] < b[0] for a, b in zip(sorted(ends), sorted(ends)[1:]))
            assert len(ends) <= max(1, 3 * len(shapes[job]) // target)


def test_phases_with_an_outlying_line_number(table):
    lines = ["Created 9 segments", "encoding", "Segment 1 done", "Segment 2 done", "noise", "Segment 3 done", "transcoding", "playlist", "x", "pipeline complete"]
    seqs = [*range(9), 10**12]
    made = table(list(zip([1] * 10, seqs, lines)), "job_id bigint, seq bigint, line string")
    got = [tuple(r) for r in jobs.log_phase(made, slice_rows=2).orderBy("seq").collect()]
    assert got == [tuple(r) for r in jobs.log_phase(made).orderBy("seq").collect()]


def test_all_payloads_in_one_pass(spark):
    """The rows of payload_rows, type by type, from a single scan."""
    from gopmill.plans import io_queries

    parsed = io_queries.sampled(spark, "/root/testdata/sf0.001").withColumn("event_id", F.col("event_id") + 0)
    typed = messages.typed_payloads(parsed)
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    kept = typed.cache()
    for name in ("JobSubmit", "SegmentAssign", "SegmentFailed", "Heartbeat", "NodeLeave"):
        want = messages.payload_rows(parsed, name)
        got = kept.where(F.col("op_name") == name).select("event_id", f"{name}.*")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    kept.unpersist()


def test_a_cluster_needs_a_shared_folder():
    """A warehouse on one machine's disk is no place for what other executors read."""
    from types import SimpleNamespace

    from gopmill import session

    def fake(master, settings):
        path = SimpleNamespace(getFileSystem=lambda conf: SimpleNamespace(getScheme=lambda: "file"))
        jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=SimpleNamespace(Path=lambda folder: path)))))
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None, _jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, *default: settings.get(name, *default)))

    warehouse = {"spark.sql.warehouse.dir": "/srv/warehouse"}
    assert session.ensure_checkpoint_dir(fake("local[4]", warehouse)) == "/srv/warehouse/_checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake("spark://host:7077", warehouse))
    assert session.ensure_checkpoint_dir(fake("spark://host:7077", {**warehouse, "spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"


def test_attempts_meet_their_grants_without_a_shuffle_but_by_ticket(spark, table):
    grants = table([("t", 1, "a.mp4", 0), ("u", 1, None, 0)], "ticket string, job_id int, filename string, at bigint")
    grants = grants.select("ticket", "job_id", "filename", F.timestamp_seconds("at").alias("issued_at"))
    tries = [(1, "t", 2, "a.mp4", 5), (2, "t", 1, "a.mp4", 7), (3, "t", 1, "a.mp4", 6), (4, "u", 1, None, 9), (5, None, 1, "a.mp4", 9)]
    made = table(tries, "attempt_id int, ticket string, job_id int, filename string, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        redeemed = access.redeem_grants(grants, made)
        keys = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\)", redeemed._jdf.queryExecution().executedPlan().toString())
        got = {r.attempt_id: r.redeemed for r in redeemed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(keys) == {"ticket"} and len(keys) == 3
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_one_large_source_is_dealt_out_by_runs_of_segments(spark, table, monkeypatch):
    sources = table([(1, 200 * 52_428_800 + 1), (2, 0), (3, None), (4, 52_428_800)], "asset_id int, size_bytes bigint").coalesce(1)
    want = sorted(one(segments.size_segments(sources).select("asset_id", "segment_id", "start_frame", "end_ts")), key=str)
    assert len(want) == 201 + 3 and [r[1] for r in sorted(r for r in want if r[0] == 1)] == list(range(201))
    monkeypatch.setattr(segments, "SEGMENTS_PER_RUN", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = segments.size_segments(sources)
        got = sorted(one(made.select("asset_id", "segment_id", "start_frame", "end_ts")), key=str)
        tasks = made.where("asset_id = 1").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and tasks > 2
