"""Legacy archive converter: ARC records of either version to WARC records.

An ARC file starts with a version block, ``filedesc://``, whose second line names the version; its
third line is the layout of the header lines. Version 1 headers have five fields (URL, IP,
date, type, length), version 2 ten (result code, checksum, location, offset and file name besides). A record's body
has the declared length. Each becomes a WARC/1.0 record with an identifier derived from its key (page_id)
and payload digest, the date in ISO form, its type, and SHA-1 digests; a body equal to that of another record becomes a
revisit of it, and refers to the identifier that follows from that record's key and the same digest. Every WARC record
is a gzip member of its own.

Defined cases: a null body is empty; a null URL is written as ``urn:null``; a record whose header
or length cannot be read raises ValueError; a row with a null page_id gets a record too, which is never revisited and revisits
the largest page_id of its payload if there is one; repeated page_ids each get a record, those of the largest with equal payloads all as
responses, under one identifier as they are equal; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_dir, sized, small_batches, until_exit

#: The header layouts of the two versions.
LAYOUT = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SEGMENT_BYTES = 8 << 20
#: Bodies from this size on can be revisits.
LEAST_REVISIT = 1000
DATE = "20200101000000"
#: The key of a row without a page_id.
NO_KEY = "null"


def arc_head(version: int, name: str) -> bytes:
    """The version block of an ARC file."""
    lines = f"{version} 0 shroudlake\n{LAYOUT[version]}\n\n"
    fields = {1: f"0.0.0.0 {DATE} text/plain {len(lines)}", 2: f"0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(lines)}"}[version]
    return f"filedesc://{name} {fields}\n{lines}".encode()


def arc_record(version: int, url: str, body: bytes, name: str, offset: int) -> bytes:
    """One record; the body is the HTTP response. White space in the URL is escaped, as header fields are split at spaces."""
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url or "urn:null")
    if version == 1:
        head = f"{url} 0.0.0.0 {DATE} text/html {len(body)}\n"
    else:
        head = f"{url} 0.0.0.0 {DATE} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: header fields by name, and body."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        head = data[at:end].decode()
        if names is None:
            layout = data[end + 1 :].split(b"\n", 2)
            version = int(layout[0].split()[0])
            if version not in LAYOUT or not head.startswith("filedesc://"):
                raise ValueError(f"not an ARC version block: {head[:80]}")
            names = LAYOUT[version].split()
        parts = head.split(" ")
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header of {len(names)} fields: {head[:80]}")
        fields = dict(zip(names, parts))
        start = end + 1
        stop = start + int(fields["Archive-length"])
        if stop > len(data):
            raise ValueError(f"a record is cut short: {head[:80]}")
        if not head.startswith("filedesc://"):
            yield fields | {"body": data[start:stop]}
        at = stop + (data[stop : stop + 1] == b"\n")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(headers with their blank line, payload) of an HTTP response."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def identity(key: str, digest: str) -> str:
    return f"{key}#{digest}"


def to_warc(fields: dict, key: str, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of ``refers_to`` with the HTTP headers only."""
    http, payload = split_http(fields["body"])
    block = http if refers_to is not None else http + payload
    kind, digest = "revisit" if refers_to is not None else "response", hashlib.sha1(payload).hexdigest()
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(identity(key, digest))}", f"WARC-Date: {iso(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"WARC-Source-Key: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(identity(refers_to, digest))}", f"WARC-Refers-To-Key: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def read_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file of gzip members: headers by name, and block."""
    view, place = memoryview(data), 0
    while place < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if place >= len(view):
                raise ValueError("a gzip member is cut short")
            parts.append(d.decompress(view[place : place + (1 << 14)]))
            place += 1 << 14
        place = min(place, len(view)) - len(d.unused_data)
        raw, at = b"".join(parts), 0
        while at < len(raw):
            stop = raw.index(b"\r\n\r\n", at)
            head = raw[at:stop].decode().split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {head[0][:40]}")
            fields = dict(x.split(": ", 1) for x in head[1:])
            size = int(fields["Content-Length"])
            yield fields | {"block": raw[stop + 4 : stop + 4 + size]}
            at = stop + 8 + size


def opener(folder: str):
    """(file system, path) of a shared folder, for executors."""
    if folder.startswith("file:") or folder.startswith("/"):
        path = urlsplit(folder).path if folder.startswith("file:") else folder
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(folder)


def with_responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, response): response is the largest page_id of the same payload, where several rows have it and it is long enough.

    The payloads that recur are looked up by broadcast if they are few; else rows are exchanged by digest, rows without one by a number of their own.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    digest = F.unhex(F.sha1("html"))
    keyed = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", digest.alias("digest"))
    largest = keyed.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL").select("digest", "response")
    alone = F.concat(F.lit(b"-"), F.xxhash64("page_id", "url").cast("string").cast("binary"))
    return rows.withColumn("digest", F.when(F.octet_length("html") >= LEAST_REVISIT, digest).otherwise(alone)).join(sized(largest, "warc-copies"), "digest", "left").select("page_id", "url", "html", "response")


def convert(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as ARC segments, version 1 and 2 in turn, converts each and puts the WARC files into ``folder``; returns (path, n_records).

    File names are a hash of the segment's content, so a task that runs again writes the same files.
    """
    small_batches(pages.sparkSession)
    joined = with_responses(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opener(folder)
        turn = 0

        def store(part: list[tuple]) -> pa.RecordBatch:
            nonlocal turn
            version, turn = 1 + turn % 2, turn + 1
            name = f"segment-{hashlib.sha1(repr([(p, u, hashlib.sha1(h).digest(), to) for p, u, h, to in part]).encode()).hexdigest()}"
            arc = io.BytesIO()
            arc.write(arc_head(version, f"{name}.arc"))
            for _, url, html, _ in part:
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
                arc.write(arc_record(version, url, head + html, f"{name}.arc", arc.tell()))
            out = io.BytesIO()
            for (page, _, _, response), fields in zip(part, read_arc(arc.getvalue()), strict=True):
                out.write(gz(to_warc(fields, NO_KEY if page is None else str(page), None if response is None or response == page else str(response))))
            temp, done = f"{top}/{name}.{uuid.uuid4().hex}.tmp", f"{top}/{name}.warc.gz"
            with fs.open_output_stream(temp) as f:
                f.write(out.getvalue())
            fs.move(temp, done)
            return pa.record_batch([pa.array([f"{folder.rstrip('/')}/{name}.warc.gz"]), pa.array([len(part)], pa.int64())], ["path", "n_records"])

        fs.create_dir(top, recursive=True)
        part, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                part.append(row)
                size += len(row[2])
                if size >= segment_bytes:
                    yield store(part)
                    part, size = [], 0
        if part:
            yield store(part)

    return joined.mapInArrow(run, "path string, n_records long")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the WARC files(path) in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opener(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{path.rsplit('/', 1)[1]}", compression=None) as f:
                    data = f.read()
                rows = []
                for r in read_warc(data):
                    http, payload = split_http(r["block"])
                    kind, digest = r["WARC-Type"], r["WARC-Payload-Digest"].split(":")[1]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {r['WARC-Record-ID']} does not have its digest")
                    size = len(payload) if kind == "response" else int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    to = r.get("WARC-Refers-To-Key")
                    own = r["WARC-Source-Key"]
                    rows.append((None if own == NO_KEY else int(own), size, digest, kind, None if to is None else int(to)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages into the shared folder and reads them back.

    Only files that a finished task reports are read, so what a lost task left behind does no harm.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    until_exit(spark, folder)
    files = durable(convert(pages, folder), "warc-files")
    return read_back(files.repartition(2 * spark.sparkContext.defaultParallelism), folder)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS r FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r IS NULL OR r IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r IS DISTINCT FROM page_id THEN r END AS refers_to FROM m
"""
