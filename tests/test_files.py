"""Named files: bytes in order, one commit, nothing left of lost attempts."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from gopmill.operators import texts
from gopmill.sources import files


def found(folder):
    root = pathlib.Path(folder)
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_bytes_in_the_order_of_the_rows(spark, tmp_path):
    rows = [(f"f{n % 7}/x", n, bytes([n % 256, 0, 255]) * (n % 5)) for n in range(500)]
    df = spark.createDataFrame(rows, "name string, at int, chunk binary")
    files.write_files(df.repartition(4, "name").sortWithinPartitions("name", "at"), f"file://{tmp_path}/out")
    want = {}
    for name, _, chunk in rows:
        want[name] = want.get(name, b"") + chunk
    assert found(tmp_path / "out") == want


def test_names_taking_turns_and_null_chunks(spark, tmp_path):
    df = spark.range(0, 90, 1, 1).select(
        F.concat(F.lit("n"), F.col("id") % 3).alias("name"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string").cast("binary")).alias("chunk")
    )
    files.write_files(df, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {f"n{k}": "".join(str(i) for i in range(90) if i % 3 == k and i % 5).encode() for k in range(3)}


def test_a_file_in_two_partitions_is_an_error_and_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 10, 1, 2).select(F.lit("one").alias("name"), F.lit(b"x").alias("chunk"))
    with pytest.raises(Exception, match="several partitions"):
        files.write_files(df, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {}


def test_names_stay_inside_the_folder(spark, tmp_path):
    df = spark.range(1).select(F.lit("../x").alias("name"), F.lit(b"x").alias("chunk"))
    with pytest.raises(Exception, match="no file name"):
        files.write_files(df, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "x")


def test_a_repeated_attempt_counts_once(tmp_path):
    """The commit takes the attempts it is told of; what a lost one wrote goes."""
    import pyarrow as pa

    writer = files._Writer(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a"], "chunk": pa.array([b"1", b"2"], pa.binary())})
    writer.write(iter([batch]))
    kept = writer.write(iter([batch]))
    writer.commit([kept, None])
    assert found(tmp_path / "out") == {"a": b"12"}
    assert not (tmp_path / "out" / files.ATTEMPTS).exists()


def test_no_rows(spark, tmp_path):
    files.write_files(spark.createDataFrame([], "name string, chunk binary"), str(tmp_path / "out"))
    assert found(tmp_path / "out") == {}


def test_a_file_for_each_asset_and_parts_of_long_ones(table, tmp_path):
    segments = [(a, s, float(s), s + 1.5) for a in (1, 2) for s in range(30 if a == 1 else 3)]
    results = table([(a, s, f"/o/{a}_{s}.ts") for a, s, *_ in segments], "asset_id bigint, segment_id int, output_path string")
    spans = table(segments, "asset_id bigint, segment_id int, start_ts double, end_ts double")
    lines = texts.hls_playlist(results, spans)
    texts.write_asset_files(lines, str(tmp_path / "out"), ".m3u8", part_lines=20)
    got = found(tmp_path / "out")
    assert set(got) == {"1.m3u8", "1.m3u8.part1", "1.m3u8.part2", "1.m3u8.part3", "2.m3u8"}
    for asset in (1, 2):
        want = "".join(r.line + "\n" for r in sorted(lines.where(f"asset_id = {asset}").collect(), key=lambda r: r.line_no))
        parts = sorted((k for k in got if k.startswith(f"{asset}.")), key=lambda k: (len(k), k))
        assert b"".join(got[k] for k in parts).decode() == want
    assert got["2.m3u8"].decode().split("\n")[4:6] == ["#EXTINF:1.500000,", "2_0.ts"]
