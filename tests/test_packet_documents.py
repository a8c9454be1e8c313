"""Packet documents in many splits give the rows of the parsed document."""

import json
import random

import pytest

from gopmill.session import written
from gopmill.sources import probe


def documents(rng):
    """Documents of many shapes: several arrays, objects and braces inside packets, quotes and escapes, odd values."""
    def packet(i):
        out = {"codec_type": "video", "pts_time": rng.choice([f"{i / 25}", "N/A", i / 2]), "size": rng.choice([str(i), i, None]), "flags": "K__" if i % 9 == 0 else "__"}
        if rng.random() < 0.2:
            out["tags"] = {"note": rng.choice(["a } brace", 'a "quoted } \\" one', "{[}]", '"packets": [ {', "\\", "\\\\}", "ü\n\t"])}
        if rng.random() < 0.15:
            out["side_data_list"] = [{"side_data_type": "x", "packets": [{"pts_time": "9.9"}]}, {}, {"y": [[1], [2, [3]]]}]
        if rng.random() < 0.1:
            out.pop("flags")
        if rng.random() < 0.1:
            out = {"note": "} first } \"", **out}
        return out if rng.random() > 0.03 else {}

    packets = [packet(i) for i in range(rng.randrange(0, 60))]
    shapes = [
        {"packets": packets},
        {"programs": [], "streams": [{"index": 0, "packets": [{"pts_time": "7"}]}], "packets": packets},
        {"packets": packets, "frames": [{"pts_time": "5", "size": "1"}] * 3, "format": {"a": {"b": [{"c": 1}]}}},
        {"format": {"x": {"packets": [{"pts_time": "8"}]}}, "n": [1, [2]], "packets": packets},
        {"frames": [{"pts_time": "5"}], "packets": packets, "end": "}"},
        {"streams": []},
    ]
    return rng.choice(shapes)


def expected(doc):
    def number(x):
        return int(str(x)) if x is not None else 0

    def time(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    return [(i, time(p.get("pts_time")), number(p.get("size")), p.get("flags", "")) for i, p in enumerate(doc.get("packets", []))]


@pytest.mark.parametrize("split", [90, 700, 5000])
def test_many_splits(spark, tmp_path, split):
    rng = random.Random(split)
    want = {}
    for n in range(12):
        doc = documents(rng)
        style = rng.choice([{}, {"indent": 4}, {"separators": (",", ":")}])
        (tmp_path / f"d{n}.json").write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, **style) + rng.choice(["", "\n"]))
        want[f"d{n}.json"] = expected(doc)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pieces = written(probe._pieces(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    if split < 5000:
        assert pieces.select("asset_path", "_block").distinct().count() > 30
    rows = probe._packets_of(pieces).collect()
    got = {name: [] for name in want}
    for r in rows:
        got[r.asset_path.rpartition("/")[2]].append((r.packet_idx, r.pts_time, r.size_bytes, r.flags))
    for name in want:
        assert sorted(got[name]) == want[name], name


def test_no_documents_with_packets(spark, tmp_path):
    for n, text in enumerate(["", "{}", "[]", "no json", '{"packets": []}', '{"packets": [1, "}", null]}', '{"packets": {"pts_time": "1"}}']):
        (tmp_path / f"{n}.json").write_text(text)
    assert probe.read_packets_json(spark, str(tmp_path)).count() == 0
