"""Streams fed in shuffled chunks end where their batch twins do."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gopmill.operators import access, gops, health, jobs
from gopmill.sources import messages
from gopmill.streaming import late, ordered, runner, streams
from test_random import fold_phase, random_logs

START = 1_700_000_000


@pytest.fixture
def chunked(spark, tmp_path):
    """A stream of one file a batch; rows stray at most ``stray`` places from their order."""

    def make(rows, schema, chunk=20, stray=6, seed=0):
        rng = random.Random(seed)
        order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, stray))
        folder = tmp_path / f"in{seed}"
        folder.mkdir()
        for n, at in enumerate(range(0, len(rows), chunk)):
            part = spark.createDataFrame([rows[i] for i in order[at : at + chunk]], schema).toPandas()
            file = folder / f"{n:04d}.parquet"
            part.to_parquet(file, coerce_timestamps="us", allow_truncated_timestamps=True)
            os.utime(file, (START + n, START + n))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def at(second):
    return pd.Timestamp(START + second, unit="s").to_pydatetime()


def test_log_phase_stream(chunked):
    logs = random_logs(random.Random(3), 6)
    rows, second = [], 0
    turn = {job: 0 for job in logs}
    while any(turn[j] < len(logs[j]) for j in logs):
        for job, lines in logs.items():
            if turn[job] < len(lines):
                rows.append((job, at(second), turn[job], lines[turn[job]]))
                turn[job] += 1
                second += 1
    rows.append((99, at(second + 1000), 0, "noise"))
    stream = chunked(rows, "job_id bigint, ts timestamp, seq bigint, line string", chunk=60)
    got = runner.run_available(streams.log_phase_stream(stream, "60 seconds"))
    found = {(r.job_id, r.seq): (r.phase, r.percent, r.segments_total, r.segments_done) for r in got.collect()}
    for job, lines in logs.items():
        assert [found[job, i] for i in range(len(lines))] == fold_phase(lines)


def test_live_gops(chunked, table):
    rng = random.Random(9)
    rows, ends = [], []
    for asset in range(3):
        count = rng.randrange(30, 60)
        for i in range(count):
            rows.append((asset, at(i * 3 + asset), i, i / 25.0, rng.randrange(1000), "K__" if rng.random() < 0.2 else "___", False))
        ends.append((asset, at(count * 3 + asset + 1), count, 0.0, 0, "", True))
    plain = sorted(rows)
    rows = sorted(rows + ends, key=lambda r: r[1]) + [(99, at(5000), 0, 0.0, 0, "___", False)]
    schema = "asset_id bigint, ts timestamp, packet_idx bigint, pts_time double, size_bytes bigint, flags string, is_end boolean"
    got = runner.run_available(streams.live_gop_stats(chunked(rows, schema), "30 seconds"))
    batch = table([(r[0], *r[2:6]) for r in plain], "asset_id bigint, packet_idx bigint, pts_time double, size_bytes bigint, flags string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gops.gop_stats(batch).collect()))


def test_liveness(chunked, table):
    rng = random.Random(17)
    beats, nodes = [], [(n, 4, rng.choice(["Joining", "Active", "Draining"])) for n in range(8)]
    for node, most, _ in nodes:
        second = 0
        for _ in range(8):
            second += rng.choice([3, 5, 25])
            beats.append((node, at(second), rng.choice([1, 4]), most))
    beats.sort(key=lambda b: b[1])
    schema = "node_id bigint, ts timestamp, active_workers bigint, max_concurrent_workers bigint"
    registry = table(nodes, "node_id bigint, max_concurrent_workers bigint, status string")
    # an unregistered node's beat moves the watermark to the judging time and nothing else
    stream = chunked(beats + [(99, at(400), 0, 4)], schema, chunk=25)
    clock = chunked([(at(400), 0)], "ts timestamp, n int", seed=1)
    got = runner.run_available(streams.node_liveness_stream(stream, registry, 10, "60 seconds", clock.select("ts")))
    end = {n: s for n, _, s in nodes}
    for r in sorted(got.collect(), key=lambda r: (r.at, r.status != "Dead")):
        end[r.node_id] = r.status
    judged = F.timestamp_seconds(F.lit(START + 340))
    batch = table(beats, schema)
    want = {r.node_id: r.status for r in health.latest_status(batch, registry, judged).collect()}
    assert end == want
    deaths = {}
    for r in got.where("status = 'Dead'").collect():
        deaths[r.node_id] = deaths.get(r.node_id, 0) + 1
    silent = health.silent_intervals(batch, judged)
    assert deaths == {r.node_id: r["count"] for r in silent.groupBy("node_id").count().collect()}


def test_progress_in_any_order(chunked, table):
    rng = random.Random(23)
    rows = [(rng.randrange(4), rng.randrange(30), seq, rng.choice(["assign", "complete", "failed"])) for seq in range(200)]
    schema = "job_id bigint, segment_id bigint, seq bigint, kind string"
    stream = chunked(rows, schema, chunk=50, stray=500)
    updates = runner.run_available(streams.job_progress_stream(stream, shards=3), "update")
    totals = table([(j, 30) for j in range(5)], "job_id bigint, total bigint")
    got = streams.job_progress_totals(updates, totals)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.job_progress(table(rows, schema), totals).collect()))


def test_grants(chunked, table):
    rng = random.Random(29)
    grants = [(f"t{n}", n % 3, "a.mp4", at(n * 10), None) for n in range(12)]
    tries = [
        (f"t{rng.randrange(14)}", rng.randrange(3), rng.choice(["a.mp4", "a.mp4", "b.mp4"]), None, at(rng.randrange(250)), i)
        for i in range(150)
    ]
    rows = [(t, j, f, when, 0, -1) for t, j, f, when, _ in grants] + [(t, j, f, when, 1, i) for t, j, f, _, when, i in tries]
    rows.sort(key=lambda r: r[3])
    rows.append(("end", 0, "", at(2000), 1, 9999))
    schema = "ticket string, job_id int, filename string, ts timestamp, is_try int, attempt_id bigint"
    stream = chunked(rows, schema, chunk=60)
    issued = stream.where("is_try = 0").select("ticket", "job_id", "filename", F.col("ts").alias("issued_at"))
    tried = stream.where("is_try = 1").select("ticket", "job_id", "filename", "ts", "attempt_id")
    got = runner.run_available(streams.grant_redemption_stream(issued, tried, 60, "60 seconds"))
    batch = access.redeem_grants(
        table([g[:4] for g in grants], "ticket string, job_id int, filename string, issued_at timestamp"),
        table([(i, t, j, f, when) for t, j, f, _, when, i in tries], "attempt_id bigint, ticket string, job_id int, filename string, ts timestamp"),
    )
    want = {r.attempt_id: r.redeemed for r in batch.collect()}
    assert {r.attempt_id: r.redeemed for r in got.where("ticket <> 'end'").collect()} == want
    assert 0 < sum(want.values()) <= 12


def test_percent_outlasts_a_zero_total(chunked):
    text = '{{"op": 32, "d": {{"job_id": "j", "completed_segments": {}, "total_segments": {}, "failed_segments": 0, "phase": "p"}}}}'
    rows = [(at(i), i, text.format(done, total)) for i, (done, total) in enumerate([(0, 0), (1, 4), (0, 0), (2, 4), (3, 0), (4, 4)])]
    rows.append((at(900), 9, text.replace('"j"', '"end"').format(0, 0)))
    stream = messages.read_messages(chunked(rows, "ts timestamp, seq bigint, raw string", chunk=3, stray=2))
    got = runner.run_available(streams.progress_percent_stream(stream, "30 seconds")).where("job_id = 'j'").orderBy("seq")
    assert [r.percent for r in got.collect()] == [0, 25, 25, 50, 50, 100]


def test_membership(chunked):
    join = '{{"op": 1, "d": {{"node_id": "{}", "listen_addr": "a{}", "capabilities": {{"max_concurrent_workers": 2}}, "event_subscriptions": 0}}}}'
    leave = '{{"op": 70, "d": {{"node_id": "{}"}}}}'
    gossip = '{"op": 2, "d": {"node_id": "x", "cluster_nodes": [{"node_id": "c", "address": "g", "status": "Busy", "capabilities": {"max_concurrent_workers": 3}}]}}'
    rows = [(at(0), join.format("a", 1)), (at(1), join.format("b", 1)), (at(2), gossip), (at(3), leave.format("b")), (at(4), join.format("a", 2))]
    made = messages.read_messages(chunked(rows, "ts timestamp, raw string", chunk=2))
    updates = runner.run_available(streams.node_membership_stream(made), "update")
    last = updates.groupBy("node_id").agg(F.max(F.struct("ts", "joined", "address", "status", "max_concurrent_workers")).alias("m"))
    got = {r.node_id: (r.m.joined, r.m.address, r.m.status, r.m.max_concurrent_workers) for r in last.collect()}
    assert got == {"a": (True, "a2", "Active", 2), "b": (False, None, None, None), "c": (True, "g", "Busy", 3)}


def test_registered_nodes_that_never_beat(spark, chunked, table):
    """The clock starts with the registration, in the stream as in the table; ticks alone let time pass."""
    rng = random.Random(41)
    nodes = [(n, 4, rng.choice(["Joining", "Active", "Draining"]), at(rng.choice([0, 30, 70])) if n else None) for n in range(10)]
    beats = []
    for node, most, _, since in nodes[:6]:
        second = rng.choice([-5, 2, 40])
        for _ in range(6):
            second += rng.choice([3, 5, 25])
            beats.append((node, at(max(second, 0)), rng.choice([1, 4]), most))
    beats += [(99, at(20), 1, 4)]
    beats.sort(key=lambda b: b[1])
    schema = "node_id bigint, ts timestamp, active_workers bigint, max_concurrent_workers bigint"
    registry = table(nodes, "node_id bigint, max_concurrent_workers bigint, status string, registered_at timestamp")
    clock = chunked([(at(s), 0) for s in (0, 0, 0, 300, 400, 401)], "ts timestamp, n int", chunk=1, stray=0, seed=1)
    stream = streams.node_liveness_stream(chunked(beats, schema, chunk=15), registry, 10, "60 seconds", clock.select("ts"))
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        got = runner.run_available(stream).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")
    assert all(r.node_id < 10 for r in got)
    end = {n: s for n, _, s, _ in nodes}
    for r in sorted(got, key=lambda r: (r.at, r.status != "Dead")):
        end[r.node_id] = r.status
    judged = F.timestamp_seconds(F.lit(START + 341))
    want = {r.node_id: r.status for r in health.latest_status(table(beats, schema), registry, judged).collect()}
    assert end == want and all(want[n] == "Dead" for n in range(6, 10))
    firsts = {r.node_id: r.at for r in got if r.status == "Dead" and r.node_id >= 6}
    assert firsts == {n: since + pd.Timedelta(seconds=10) for n, _, _, since in nodes[6:]}


def state_rows(stream, mode="append"):
    """State rows after each batch of a stream, by its own progress reports."""
    spark = stream.sparkSession
    runner.use_rocksdb(spark)
    base = runner.fresh_folder(spark)
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    query = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress if p.stateOperators]


FAR_AHEAD = 50_000


def jobs_then_silence(schema, row):
    """Forty rows of eight keys, then single rows far ahead that let the watermark pass."""
    return [row(f"k{i % 8}", at(i), i) for i in range(40)] + [row("end", at(FAR_AHEAD + i), 1000 + i) for i in range(60)]


@pytest.mark.parametrize("which", ["phase", "percent", "progress", "uploads"])
def test_state_is_forgotten(chunked, which):
    """After the last row of a job or upload and the time to keep it, nothing of it is left."""
    progress = '{{"op": 32, "d": {{"job_id": "{}", "completed_segments": 1, "total_segments": 4, "failed_segments": 0, "phase": "p"}}}}'
    made = {
        "phase": ("job_id string, ts timestamp, seq bigint, line string", lambda k, t, i: (k, t, i, "Segment 1 done")),
        "percent": ("seq bigint, ts timestamp, raw string", lambda k, t, i: (i, t, progress.format(k))),
        "progress": ("job_id string, ts timestamp, segment_id bigint, seq bigint, kind string", lambda k, t, i: (k, t, i, i, "complete")),
        "uploads": ("upload_id string, ts timestamp, ok boolean", lambda k, t, i: (k, t, True)),
    }
    schema, row = made[which]
    stream = chunked(jobs_then_silence(schema, row), schema, chunk=20, stray=0)
    start = {
        "phase": lambda keep: streams.log_phase_stream(stream, "10 seconds", keep),
        "percent": lambda keep: streams.progress_percent_stream(messages.read_messages(stream), "10 seconds", keep),
        "progress": lambda keep: streams.job_progress_stream(stream, 4, keep, "10 seconds"),
        "uploads": lambda keep: streams.ingest_sources_once_stream(stream, keep),
    }[which]
    mode = "update" if which == "progress" else "append"
    kept = state_rows(start(None), mode)
    freed = state_rows(start(100), mode)
    assert max(freed) >= 8 and freed[-1] < max(freed)
    # what is left is the last key's, which is still being written
    assert kept[-1] - freed[-1] >= 8, (kept, freed)


def test_a_job_that_comes_back_counts_anew(chunked, table):
    rows = [("a", at(i), i, i, "complete") for i in range(10)] + [("b", at(5000 + i), i, i, "complete") for i in range(40)]
    rows += [("a", at(9000 + i), i, 100 + i, "complete") for i in range(3)]
    schema = "job_id string, ts timestamp, segment_id bigint, seq bigint, kind string"
    updates = runner.run_available(streams.job_progress_stream(chunked(rows, schema, chunk=10, stray=0), 2, 100, "10 seconds"), "update")
    totals = streams.job_progress_totals(updates, table([("a", 10), ("b", 40)], "job_id string, total bigint"))
    assert {r.job_id: r.completed for r in totals.collect()} == {"a": 3, "b": 40}


def test_silence_closes_the_last_gop(chunked):
    rows = [(a, at(i), i, i / 25.0, 10, "K__" if i % 7 == 0 else "___", False) for i in range(20) for a in (1, 2)]
    rows += [(3, at(9000 + i), i, 0.0, 1, "___", False) for i in range(40)]
    schema = "asset_id bigint, ts timestamp, packet_idx bigint, pts_time double, size_bytes bigint, flags string, is_end boolean"
    got = runner.run_available(streams.live_gop_stats(chunked(rows, schema, stray=0), "10 seconds", 60))
    assert sorted((r.asset_id, r.gop_idx, r.end_frame) for r in got.collect() if r.asset_id < 3) == [(a, g, e) for a in (1, 2) for g, e in ((0, 6), (1, 13), (2, 19))]


def test_late_rows_are_counted(chunked, spark, tmp_path):
    """Rows the watermark drops are noted for their query and batch, and no others."""
    lines = [("j", at(i), i, "noise") for i in range(40)] + [("j", at(5000), 90, "noise")] * 20
    lines += [("j", at(100 + i), 100 + i, "noise") for i in range(13)] + [("j", at(5001 + i), 200 + i, "noise") for i in range(7)]
    lines += [("k", at(6000 + i), i, "noise") for i in range(20)] + [("j", at(200 + i), 300 + i, "noise") for i in range(5)] + [("k", at(7000 + i), i, "noise") for i in range(15)]
    schema = "job_id string, ts timestamp, seq bigint, line string"
    folder = f"file://{tmp_path}/late"
    with late.LateRows(spark, folder):
        stream = streams.log_phase_stream(chunked(lines, schema, chunk=20, stray=0), "10 seconds")
        seen = {r.seq for r in runner.run_available(stream).where("job_id = 'j'").collect()}
    noted = late.late_rows(spark, folder).collect()
    dropped = [seq for job, _, seq, _ in lines if job == "j" and seq not in seen]
    assert sum(r.late_rows for r in noted) == len(dropped) >= 5
    assert len({(r.query_id, r.batch_id) for r in noted}) == len(noted)
    assert [r.late_rows for r in late.late_rows_per_query(spark, folder).collect()] == [len(dropped)]


def test_no_late_rows(chunked, spark, tmp_path):
    with late.LateRows(spark, str(tmp_path / "late")):
        runner.run_available(streams.log_phase_stream(chunked([("j", at(i), i, "x") for i in range(30)], "job_id string, ts timestamp, seq bigint, line string"), "60 seconds"))
    assert late.late_rows(spark, str(tmp_path / "late")).count() == 0


class _Held:
    """What a state handle keeps for one key, without Spark."""

    def __init__(self):
        self.rows, self.value, self.timers, self.most = [], None, [], 0
        self.getListState = self.getValueState = lambda *_: self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _HeldList(_Held):
    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


def test_waiting_rows_lie_in_chunks_and_come_back_in_order(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 7)

    class Each(ordered.InOrder):
        columns, outputs = ("n", "name"), ("ts", "n", "name")
        pending_schema, state_schema = "ts bigint, n bigint, name string", "count bigint"

        def start(self, key):
            return (0,)

        def fold(self, key, state, row):
            return (state[0] + 1,), [row]

    handle, listed = _Held(), _HeldList()
    handle.getListState = lambda *_: listed
    each = Each()
    each.init(handle)
    rng = random.Random(3)
    rows = [(t // 3, n, None if n % 4 == 0 else f"n{n}") for n, t in enumerate(rng.sample(range(300), 100))]

    def batches(some):
        for at in range(0, len(some), 20):
            part = pd.DataFrame(some[at : at + 20], columns=["ts", "n", "name"])
            yield part.assign(ts=part["ts"].astype("datetime64[ms]"))

    def run(some, now):
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: now})()
        given = list(each.handleInputRows((1,), batches(some), clock))
        assert all(len(g) <= 7 for g in given)
        return [tuple(None if pd.isna(v) else v for v in r) for g in given for r in g.itertuples(index=False)]

    def in_order(some):
        return sorted(some, key=lambda r: tuple((v is not None, v) for v in r))

    assert run(rows[:60], -1) == [] and 9 <= len(listed.rows) <= 15 and handle.timers == [min(rows[:60])[0]]
    assert run(rows[60:], 40) == in_order(r for r in rows if r[0] <= 40)
    later = [r for r in rows if r[0] > 40]
    assert len(listed.rows) < len(later) and handle.timers == [min(later)[0]]
    assert run([], 200) == in_order(later) and listed.rows == [] and handle.value == (max(later)[0], 100)


def test_a_new_shard_of_progress_asks_its_state_once():
    class Fresh(_Held):
        def __init__(self):
            super().__init__()
            self.segments, self.getMapState = {}, lambda *_: self

        def updateValue(self, key, value):
            self.segments[key] = value

        def listTimers(self):
            raise AssertionError("a new key has no timer")

    fresh = Fresh()
    fold = streams._Progress(1000)
    fold.init(fresh)
    kinds = [(1, 5, "complete", 70), (1, 4, "failed", 90), (2, 6, "assign", 80), (3, 7, "odd", None)]
    rows = [Row(segment_id=s, seq=q, kind=k, at_ms=at) for s, q, k, at in kinds]
    (out,) = fold.handleInputRows((9, 0), iter(rows), None)
    assert tuple(out) == (9, 0, 90, 1, 0, 1) and fresh.timers == [1090]
    assert fresh.segments == {(1,): (5, "complete"), (2,): (6, "assign"), (3,): (7, "odd")}
