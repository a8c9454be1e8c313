"""WARC archives of web pages, and a normaliser of archives that are one gzip stream.

``write_archives`` writes a record per page with Spark's own text writer: a file is one gzip stream over all its records, as
many crawlers leave it, so nothing in it can be reached without inflating all before it. ``normalise`` inflates each such
file once, as a stream, writes every record again as a gzip member of its own, and beside each file an index of where the
members lie. ``read_archives`` reads any stretch of an index and goes to its members straight.

Records with equal payloads: the page with the smallest id among them has the response, the others a revisit that names it
and has the payload's digest and length but not the payload. Payloads under REVISIT_FROM bytes are always stored.

How it runs: digests are joined with those that occur more than once only; their smallest ids are a minimum reduced before
the shuffle. The inflated stream passes a task record by record, so memory is that of the largest record, not of the file; a
gzip stream cannot be entered in the middle, so a file is one task's work, and ``records_per_file`` bounds the files written
here. Members and indexes go through ``sources.files``: a task writes under its attempt's name, the commit moves what counts.
Readers get the index cut into stretches of READ_BYTES, whatever the size of the files.

A null html is an empty payload, a null url 'about:blank'; line ends inside a url are written as %0D and %0A. Pages that share
the smallest id of their payload are all responses; a null id is larger than any other, and the id that a revisit of a null id
refers to is null. Other columns are left out. An empty table gives no records. A file that is cut off inside a record is an
error that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gopmill.sources.files import filesystem, write_files
from gopmill.streaming.runner import fresh_folder

REVISIT_FROM = 100
RECORDS_PER_FILE = 50_000
READ_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
URN = "urn:x-page:"
INDEX = "offset bigint, length bigint, type string, id string, digest string"


def decided(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Pages(page_id, url, payload) with the payload's length and digest, whether it is a revisit, and of which page."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )
    long = rows.where(F.col("payload_bytes") >= least)
    firsts = long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
    repeated = firsts.where(F.col("_n") > 1).select("payload_digest", "first_id", F.lit(True).alias("_repeated"))
    revisit = F.coalesce("_repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(repeated, "payload_digest", "left").withColumn("revisit", revisit).select(*rows.columns, "revisit", "first_id")


def _urn(page: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record(date: str = DATE) -> Column:
    """Text of a record of ``decided``, without the two line ends after it."""
    url = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("about:blank"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    revisit = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("first_id")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.when(F.col("revisit"), revisit).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block,
    )


def write_archives(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A gzip stream of records per file. The writer's separator is what ends a record anyway."""
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": records_per_file}
    decided(pages).select(record().alias("value")).write.options(**options).text(folder)


# -- the normaliser ----------------------------------------------------------------------------------------------------


class Records:
    """Cuts an inflated archive, fed piece by piece, into records. Holds no more than one record and a piece."""

    LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*(?:\r\n|$)", re.IGNORECASE)

    def __init__(self, name: str):
        self.name, self.held, self.need = name, bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(header without its empty line, block) of each record that ends here."""
        self.held += piece
        while len(self.held) >= self.need:
            lead = len(self.held) - len(self.held.lstrip(b"\r\n"))
            if lead:
                del self.held[:lead]
            head = self.held.find(b"\r\n\r\n")
            if head < 0:
                self.need = len(self.held) + 1
                return
            header = bytes(self.held[:head])
            length = self.LENGTH.search(header)
            if not header.startswith(b"WARC/") or length is None:
                raise ValueError(f"{self.name}: no WARC record where one should start")
            end = head + 4 + int(length[1])
            if len(self.held) < end:
                self.need = end
                return
            yield header, bytes(self.held[head + 4 : end])
            del self.held[:end]
            self.need = 0

    def close(self) -> None:
        if self.held.strip(b"\r\n"):
            raise ValueError(f"{self.name} ends inside a record")


def field(header: bytes, name: bytes) -> str | None:
    """A named field of a record's header."""
    found = re.search(rb"\r\n" + re.escape(name) + rb":[ \t]*([^\r\n]*)", header, re.IGNORECASE)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _members(level: int):
    """Named chunks of the normalised archives and their indexes, from the pieces of inflated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name, records, offset = None, None, None, 0
        members, index, size, names = [], [], 0, set()

        def flush():
            chunks = [b"".join(members), "".join(index).encode()]
            members.clear()
            index.clear()
            return pa.RecordBatch.from_pydict({"name": [f"{name}.warc.gz", f"{name}.idx"], "chunk": pa.array(chunks, pa.binary())})

        for batch in batches:
            for path, piece in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if path != at:
                    if records is not None:
                        records.close()
                        yield flush()
                    at, name, records, offset, size = path, path.rpartition("/")[2].split(".")[0], Records(path), 0, 0
                    if name in names:
                        raise ValueError(f"{path}: another archive has this name")
                    names.add(name)
                for header, block in records.feed(piece + END.encode()):
                    member = gzip.compress(header + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)
                    entry = {
                        "offset": offset, "length": len(member), "type": field(header, b"WARC-Type"),
                        "id": field(header, b"WARC-Record-ID"), "digest": field(header, b"WARC-Payload-Digest"),
                    }
                    members.append(member)
                    index.append(json.dumps(entry) + "\n")
                    offset += len(member)
                    size += len(member)
                    if size >= BATCH_BYTES:
                        yield flush()
                        size = 0
        if records is not None:
            records.close()
            yield flush()

    return run


def normalise(spark: SparkSession, source: str, folder: str, level: int = 6) -> None:
    """Rewrites each archive ``<name>.*`` in ``source`` as ``<name>.warc.gz``, a member a record, and ``<name>.idx``.

    Two archives of one name are an error. Spark inflates the files whose names say that they are compressed, by several
    gzip members as well as one, and hands over what stands between blank lines, which is put together again. ``folder`` is
    one that ``sources.files`` can write.
    """
    pieces = spark.read.option("lineSep", END).text(source).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")
    )
    write_files(pieces.mapInArrow(_members(level), "name string, chunk binary"), folder)


# -- reading back ------------------------------------------------------------------------------------------------------


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, type, id, digest) of every record."""
    rows = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)
    return rows.withColumn("archive", F.regexp_replace("_metadata.file_path", r"\.idx$", ".warc.gz"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, stream = None, None
    for batch in batches:
        out = []
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if archive != path:
                store, inside = filesystem(archive)
                path, stream = archive, store.open_input_file(inside)
            data = gzip.decompress(stream.read_at(length, offset))
            head = data.index(b"\r\n\r\n")
            header, block = data[:head], data[head + 4 : -4]
            http = block.index(b"\r\n\r\n") + 4
            own = {k: field(header, f"WARC-{k}".encode()) for k in ("Type", "Record-ID", "Target-URI", "Payload-Digest", "Refers-To")}
            payload = block[http:] if own["Type"] == "response" else None
            digest = (own["Payload-Digest"] or "").rpartition(":")[2]
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{archive}: the record at {offset} does not match its digest")
            size = int(field(block[: http - 2], b"Content-Length") or 0)
            out.append((own["Record-ID"], own["Type"], own["Target-URI"], size, digest, own["Refers-To"], payload))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=READ)


READ = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to_id", "payload"]


def read_archives(index: DataFrame) -> DataFrame:
    """Records of a (part of an) index: ids, type, url, length and digest of the full payload, and a response's payload.

    A response whose payload does not match its digest is an error.
    """
    # an index is small beside what it points to, so the number of tasks is that of the stretches, not of the index's bytes
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.call_function("div", F.col("offset"), F.lit(READ_BYTES))
    rows = index.select("archive", "offset", "length").repartition(total // READ_BYTES + 1, "archive", stretch)
    rows = rows.sortWithinPartitions("archive", "offset")
    schema = "record_id string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to_id string, payload binary"
    return rows.mapInArrow(_read, schema)


def page_of(urn: Column) -> Column:
    """The page id in a record's id; null where there is none."""
    return F.regexp_extract(urn, rf"{URN}(-?[0-9]+)", 1).try_cast("bigint")


def op13(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back the archives of all pages, in the application's scratch folder."""
    spark = pages.sparkSession
    raw, made = fresh_folder(spark, "warc-stream"), fresh_folder(spark, "warc")
    write_archives(pages, raw)
    normalise(spark, raw, made)
    found = read_archives(read_index(spark, made))
    return found.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", page_of(F.col("refers_to_id"))).alias("refers_to"),
    )


ORACLE = f"""WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM firsts"""
