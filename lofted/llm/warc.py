"""ARC to WARC conversion, WARC files with revisits, and their reader."""

from __future__ import annotations

import base64
import hashlib
import io
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of compressed records after which a task closes a file, and of a legacy file that pages are put into first.
FILE_BYTES, ARC_BYTES = 16 << 20, 4 << 20
#: Bytes of a file that are unpacked at a time.
READ_BYTES = 1 << 16
# The field lines of the two ARC versions and the WARC revisit profile.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    #: Name of the file that it was read from, and its first byte there.
    name: str = "-"
    offset: int = 0


def _field(text: str | None, missing: str = "-") -> str:
    """A header field: white space and control characters percent-encoded."""
    if not text:
        return missing
    return "".join(c if c > " " and c != "\x7f" and c not in "\x85  \xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def arc_version_block(version: int, name: str, date: str) -> bytes:
    """The record with which an ARC file begins, naming the fields of the others."""
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = f"0.0.0.0 {date} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return f"filedesc://{name} {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(r: ArcRecord) -> bytes:
    """One record of an ARC file: header line, block of the declared length, line feed."""
    middle = f" 200 {base32_sha1(r.block)} - {r.offset} {r.name}" if r.version == 2 else ""
    return f"{r.url} {r.ip} {r.date} {r.mime}{middle} {len(r.block)}\n".encode() + r.block + b"\n"


def parse_arc(file: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, read in order.

    The field line of the version block decides how header lines are read;
    the URL may hold spaces, so the other fields are counted from the right.
    """
    fields, version, name, at = (), 0, "-", 0
    while raw := file.readline():
        start, at = at, at + len(raw)
        if raw == b"\n":  # between records
            continue
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not fields and not line.startswith("filedesc://"):
            raise ValueError("an ARC file begins with a filedesc line")
        size = int(line.rpartition(" ")[2])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("an ARC record is shorter than its header line declares")
        at += size
        if not fields:
            name = line.removeprefix("filedesc://").partition(" ")[0]
            head, names = block.decode("utf-8", "replace").split("\n")[:2]
            version, fields = int(head.split(" ")[0]), tuple(names.split())
            if version not in ARC_FIELDS or fields != ARC_FIELDS[version]:
                raise ValueError(f"unknown ARC version or fields: {head!r}")
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} of {len(fields)} fields")
        own = dict(zip(fields, values))
        yield ArcRecord(version, own["URL"], own["IP-address"], own["Archive-date"], own["Content-type"], block, name, start)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP response."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def warc_date(date: str) -> str:
    """An ARC date of 14 digits (8 or 12 in older files) as a WARC date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(r: ArcRecord) -> str:
    """A WARC record identifier, the same for each conversion of one ARC record."""
    return f"urn:uuid:{uuid.uuid5(_RECORDS, f'{r.name} {r.offset} {r.url} {r.date}')}"


def convert(r: ArcRecord, refers_to: tuple[str, str, str] | None = None, refers_key: int | None = None) -> bytes:
    """The WARC record of an ARC record: identifier, timestamp, type and digests.
    With `refers_to` (identifier, URI and date of another record) it becomes a
    revisit, which keeps the HTTP head but not the payload; `refers_key` is the
    page_id of that record."""
    head, payload = http_parts(r.block)
    block = r.block if refers_to is None else head
    kind = "response" if refers_to is None and head else "resource" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(r)}>",
        f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Type: {'application/http; msgtype=response' if head else r.mime}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", *(f"{k}: {v}" for k, v in zip(("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"), (f"<{refers_to[0]}>", *refers_to[1:])))]
    if refers_key is not None:
        lines.append(f"Refers-To-Page: {refers_key}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _packed(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-case) and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:size]


def members(file: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a file, one record each, read a block at a time."""
    d, parts, begun, data = zlib.decompressobj(31), [], False, b""
    while data or (data := file.read(READ_BYTES)):
        parts.append(d.decompress(data))
        begun, data = not d.eof, d.unused_data
        if d.eof:
            yield b"".join(parts)
            d, parts = zlib.decompressobj(31), []
    if begun:
        raise ValueError("a WARC file is cut off")


class _Writer:
    """The WARC files of one task: names are new in each attempt."""

    def __init__(self, folder: str):
        self.folder, (self.where, self.root) = folder, fs.FileSystem.from_uri(folder)
        self.part, self.held, self.size, self.name = TaskContext.get().partitionId(), [], 0, ""

    def add(self, record: bytes) -> str:
        """Takes a record; the URI of the file that it will be in."""
        self.name = self.name or f"{self.part:06d}-{uuid.uuid4().hex}.warc.gz"
        self.held.append(_packed(record))
        self.size += len(self.held[-1])
        return f"{self.folder}/{self.name}"

    def close(self) -> None:
        if self.held:
            with self.where.open_output_stream(f"{self.root}/{self.name}", compression=None) as f:
                for x in self.held:
                    f.write(x)
        self.held, self.size, self.name = [], 0, ""


def _http(page_id: int | None, payload: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode() + payload


def _date(page_id: int | None) -> str:
    """The table has no dates, so a page's is its page_id in seconds after 2000 began."""
    return time.strftime("%Y%m%d%H%M%S", time.gmtime(946_684_800 + (page_id or 0) % 1_000_000_000))


def plan_roles(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """`page_id, url, html, digest` and `first`, the page_id to refer to (null for
    responses); and the table (digest, top) of payloads that are referred to."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    long_enough = keyed.where(F.octet_length("html") >= min_bytes)
    repeated = long_enough.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    # written first, so that its join can deal a hot payload's rows to several tasks
    tops = scratch.save(repeated.select("digest", "top"), "tops")
    first = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return keyed.join(tops, "digest", "left").select("page_id", "url", "html", "digest", first.alias("first")), tops


_INDEX = "file string, page_id long, record_id string, uri string, date string"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "page_id", "record_id", "uri", "date"])


def write_warc(roles: DataFrame, folder: str) -> DataFrame:
    """Puts pages into ARC files of both versions in turn, converts these, and
    lazily writes WARC files to `folder`; returns an index of their records (file,
    page_id, record_id, uri, date), to be saved before use.

    Rows: page_id, url, html, first (null, or the page_id referred to) and
    `refers` (null, or record_id, uri and date of the response referred to).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, ready, arc, files = _Writer(folder), [], [], [], 0

        def close() -> None:
            out.close()
            ready.extend(rows)
            rows.clear()

        def flush() -> None:
            nonlocal files
            if not arc:
                return
            files += 1
            version, name = files % 2 + 1, f"{out.part}-{files}-{uuid.uuid4().hex}.arc"
            legacy = io.BytesIO()
            legacy.write(arc_version_block(version, name, arc[0][2]))
            for page_id, url, date, block, *_ in arc:
                legacy.write(arc_record(ArcRecord(version, _field(url, "unknown:-"), "0.0.0.0", date, "text/html", block, name, legacy.tell())))
            legacy.seek(0)
            for r, (page_id, _, _, _, first, refers) in zip(parse_arc(legacy), arc, strict=True):
                file = out.add(convert(r, refers and (refers["record_id"], refers["uri"], refers["date"]), first))
                rows.append((file, page_id, record_id(r), r.url, warc_date(r.date)))
                if out.size >= FILE_BYTES:
                    close()
            arc.clear()

        held = 0
        for b in batches:
            for page_id, url, html, first, refers in zip(*(b.column(c) for c in range(5))):
                page_id = page_id.as_py()
                block = _http(page_id, (html.as_py() or "").encode())
                arc.append((page_id, url.as_py(), _date(page_id), block, first.as_py(), refers.as_py()))
                held += len(block)
                if held >= ARC_BYTES:
                    flush()
                    held = 0
            if ready:  # of files that are written
                yield _told(ready)
                ready.clear()
        flush()
        close()
        if ready:
            yield _told(ready)

    return roles.select("page_id", "url", "html", "first", "refers").mapInArrow(write, _INDEX)


def convert_arc(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Converts stored ARC files (column `file`, URIs; one task each) to WARC files
    in `folder`: the index of their records, as of `write_warc` with null
    page_ids, to be saved before use.  Null names are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder)
        for b in batches:
            for file in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(file)
                rows = []
                with where.open_input_stream(name) as f:  # *.gz is unpacked
                    for r in parse_arc(io.BufferedReader(f, READ_BYTES)):
                        rows.append((out.add(convert(r)), None, record_id(r), r.url, warc_date(r.date)))
                        if out.size >= FILE_BYTES:
                            out.close()
                out.close()
                if rows:
                    yield _told(rows)

    named = files.select("file").where("file is not null").distinct()
    return named.repartition(max(1, min(named.count(), 10_000)), "file").mapInArrow(run, _INDEX)


def read_warc(index: DataFrame) -> DataFrame:
    """Per record of the files of a saved index: page_id, payload_bytes,
    payload_digest, record_type, refers_to (a page_id), url, record_id,
    refers_to_id.  A response's payload must have the digest that its header
    states."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_id"]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        number = lambda x: x and int(x)
        for b in batches:
            for file in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(file)
                rows = []
                with where.open_input_stream(name, compression=None) as f:
                    for record in members(f):
                        fields, block = parse_warc(record)
                        head, payload = http_parts(block)
                        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{file}: a payload has not its digest")
                        size = int(http["content-length"]) if "content-length" in http else len(payload)
                        refers = fields.get("warc-refers-to")
                        rows.append((number(http.get("x-page-id")), size, digest, fields["warc-type"], number(fields.get("refers-to-page")), fields["warc-target-uri"], fields["warc-record-id"].strip("<>"), refers and refers.strip("<>")))
                        if len(rows) == 10_000:
                            yield told(rows)
                            rows = []
                if rows:
                    yield told(rows)

    files = index.select("file").distinct()
    files = files.repartition(max(1, min(files.count(), 10_000)), "file")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string")


def archive(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Writes the records of `pages`, responses first, then the revisits that refer
    to them; the saved index of all."""
    roles, tops = plan_roles(pages, scratch, min_bytes)
    folder = scratch.folder("files")
    kind = "struct<record_id:string,uri:string,date:string>"
    responses = scratch.save(write_warc(roles.where("first is null").withColumn("refers", F.lit(None).cast(kind)), folder), "responses")
    # of rows repeated under one page_id the least identifier is referred to
    referred = responses.join(tops.select(F.col("top").alias("page_id"), "digest"), "page_id").groupBy("digest").agg(F.min(F.struct("record_id", "uri", "date")).alias("refers"))
    referred = scratch.save(referred, "referred")
    revisits = scratch.save(write_warc(roles.where("first is not null").join(referred, "digest"), folder), "revisits")
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC record per row of `pages` (page_id, url, html; others are
    ignored) to the shared folder and returns what the archives hold.

    Null html is an empty payload, null url the URI `unknown:-`.  Of equal
    payloads the largest page_id's is the response; repeated rows of that
    page_id are responses each; rows of null page_id refer to it, and are
    responses where no row of that payload has a page_id.
    """
    return read_warc(archive(pages, Scratch(pages.sparkSession, "warc"), min_bytes))
