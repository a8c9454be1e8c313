import gzip
import hashlib
import pathlib
import re
import zlib

import pytest
from conftest import with_clashes
from fixtures import FOLDER

from gopmill.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def brute(rows):
    out = []
    for r in rows:
        payload = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        first = min(same, default=None)
        revisit = len(payload) >= 100 and r.page_id != first
        out.append((r.page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def edges():
    page = "<p>über " + "x" * 120 + "</p>"
    breaks = "\r\n\r\nWARC/1.1\r\n\r\n" * 12
    return [
        (5, "http://a/", page), (3, "http://b/\r\nWARC-Type: x", page), (9, None, page), (3, "http://b2/", page), (1, "u", None), (2, "u", ""),
        (4, "u", "short"), (6, "u", "short"), (7, "u", breaks), (8, "u", breaks + "\r\n"), (10, "u", breaks), (11, "u", "\r\n" * 60),
        (None, "u", page), (None, "u", "n" * 200), (None, "u", "n" * 200), (12, "u", "a\x00\x0bé\r" * 50000), (-4, "u", "\n\r" * 70), (13, "u", "end\r\n\r"),
    ]


@pytest.fixture(params=["pages", "edges", "empty", "wide"])
def pages(request, spark):
    if request.param == "pages":
        return spark.read.parquet(f"{FOLDER}/pages.parquet")
    made = spark.createDataFrame([] if request.param == "empty" else edges(), SCHEMA).repartition(3)
    return with_clashes(made).withColumn("payload", warc.F.lit(1)) if request.param == "wide" else made


def test_against_brute_force(pages):
    assert sorted(map(tuple, warc.op13(pages).collect()), key=str) == brute(pages.select("page_id", "url", "html").collect())


def files(folder, end):
    return sorted(p for p in pathlib.Path(folder).glob(f"*{end}"))


def test_archives_and_indexes(spark, tmp_path):
    """One gzip stream a file before; after it a member a record, at the offsets of the index, with the same bytes."""
    pages = spark.createDataFrame(edges(), SCHEMA).coalesce(2)
    raw, made = str(tmp_path / "raw"), str(tmp_path / "made")
    warc.write_archives(pages, raw, records_per_file=4)
    warc.normalise(spark, raw, made)
    whole = {}
    for file in files(raw, ".gz"):
        stream = zlib.decompressobj(31)
        whole[file.name.split(".")[0]] = stream.decompress(file.read_bytes())
        assert stream.eof and not stream.unused_data
    assert len(whole) >= 5
    entries = warc.read_index(spark, made).collect()
    assert len(entries) == len(edges())
    for file in files(made, ".warc.gz"):
        data = file.read_bytes()
        assert gzip.decompress(data) == whole[file.name.split(".")[0]]
        own = sorted((e.offset, e.length, e.id) for e in entries if e.archive.endswith(file.name))
        assert [o for o, *_ in own] == [sum(length for _, length, _ in own[:i]) for i in range(len(own))]
        for offset, length, urn in own:
            record = gzip.decompress(data[offset : offset + length])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert re.search(rb"WARC-Record-ID: ([^\r]*)", record)[1].decode() == urn
    html = {r.record_id: r.payload for r in warc.read_archives(warc.read_index(spark, made)).collect() if r.record_type == "response"}
    assert html["<urn:x-page:12>"].decode() == edges()[15][2]


@pytest.mark.parametrize("step", [1, 7, 100, 10**6])
def test_records_of_any_pieces(step):
    blocks = [b"", b"\r\n\r\n" * 3, b"abc", b"x" * 300 + b"\r\n"]
    data = b"".join(b"WARC/1.0\r\ncontent-length:  %d\r\nX: y\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    records = warc.Records("f")
    got = [block for at in range(0, len(data), step) for _, block in records.feed(data[at : at + step])]
    records.close()
    assert got == blocks


def test_members_of_another_writer(spark, tmp_path):
    """Archives that already have a member a record, or none at all, are read the same way."""
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "members.warc.gz").write_bytes(gzip.compress(record) * 3)
    (tmp_path / "raw" / "plain.warc").write_bytes(record * 2)
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "made"))
    got = warc.read_index(spark, str(tmp_path / "made")).groupBy("archive").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3]


@pytest.mark.parametrize("data", [b"WARC/1.0\r\nContent-Length: 50\r\n\r\nhi\r\n\r\n", b"no record\r\n\r\nat all"])
def test_broken_archives_are_named(spark, tmp_path, data):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "bad.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "made"))
    assert not files(tmp_path / "made", ".gz")


def test_two_archives_of_one_name(spark, tmp_path):
    record = b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.warc.gz").write_bytes(gzip.compress(record))
    (tmp_path / "raw" / "a.warc").write_bytes(record)
    with pytest.raises(Exception, match="another archive|several partitions"):
        warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "made"))
