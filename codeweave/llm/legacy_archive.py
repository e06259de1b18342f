"""Converter of legacy ARC archives to WARC, and readers of both.

ARC: a version block, the first record of a file, names the version and the fields of each record's header line; version
1 has five fields, version 2 has ten. A header line ends with the declared length of the block that follows; URLs may hold
spaces, so fields are counted from the right. Members may be compressed one by one. What a record is goes by its place,
never by its URL, which may look like anything.

WARC 1.0: identifiers are version-5 UUIDs of URL, date, digest and place, so a task that runs again writes the same
record; dates of 4 to 14 digits become ISO 8601; blocks that begin with an HTTP status line become `response`, others
`resource`, the version block `warcinfo`; digests are SHA-1 in base 32. A record whose payload another record holds
becomes `revisit`: the HTTP header stays, the payload goes, and the other's identifier, URI and date are named.

Each ARC file becomes one WARC file. What moves between tasks is a narrow index of the records, by digest, and back to
a file of verdicts for each archive; records themselves are read and written in one task.

Edge cases: null html counts as empty; null URLs become `urn:page:<id>`; among equal payloads all rows with the largest
page_id are responses and the others, null page_ids included, revisit it; payloads whose rows have no page_id at all stay
responses; a record that ends before its declared length raises; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Fields of a header line, by version (fixed values of the format).
FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:legacy-archive")
#: Bytes of an archive before compression, about.
FILE_BYTES = 32 << 20
LEVEL = 1


@dataclass
class ArcRecord:
    version: int
    #: By the format's names; a version block has `archive`, too, the file's name.
    fields: dict[str, str]
    block: bytes
    offset: int


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def deflate(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file one by one, unpacked; a plain file as a whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            chunk = view[at : at + 16384]
            if not chunk:
                raise ValueError("a gzip member that ends early")
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        yield b"".join(out)


# --- ARC ------------------------------------------------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 codeweave\n{' '.join(_TITLES[version])}\n\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body


#: Titles of the fields in a version block (fixed values of the format).
_TITLES = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, status: int = 200, name: str = "-", offset: int = 0) -> bytes:
    middle = f"{mime}" if version == 1 else f"{mime} {status} - - {offset} {name}"
    return f"{url} {ip} {date} {middle} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive."""
    base = version = 0
    for member in members(data):
        at = 0
        while True:
            while member[at : at + 1] in (b"\n", b"\r"):
                at += 1
            if at >= len(member):
                break
            end = member.find(b"\n", at)
            if end < 0:
                raise ValueError("a header line that does not end")
            line = member[at:end].decode("utf-8", "replace").rstrip("\r")
            head = None
            if not version:  # the first record
                if not line.startswith("filedesc://"):
                    raise ValueError("no version block")
                head = re.match(rb"([12]) \d+ ", member[end + 1 : end + 40])
                if not head:
                    raise ValueError("an unknown version of ARC")
                version = int(head[1])
            names = FIELDS[version]
            parts = line.rsplit(" ", len(names) - 1)
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ValueError(f"a header line that version {version} does not have: {line[:200]}")
            size = int(parts[-1])
            block = member[end + 1 : end + 1 + size]
            if len(block) != size:
                raise ValueError("a record that ends before its declared length")
            fields = dict(zip(names, parts, strict=True)) | ({"archive": parts[0].removeprefix("filedesc://")} if head else {})
            yield ArcRecord(version, fields, block, base + at)
            at = end + 1 + size
        base += len(member)


# --- WARC -----------------------------------------------------------------------------------------------------------


def iso(date: str) -> str:
    """20010203040506, or its first 4 to 12 digits, as 2001-02-03T04:05:06Z."""
    digits = re.sub(r"\D", "", date)[:14]
    if len(digits) < 4:
        digits = "1970"
    d = digits + "00000101000000"[len(digits) :] if len(digits) >= 8 else (digits + "0101"[len(digits) - 4 :])[:8] + "000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header with its empty line, and payload; None for what is no HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    for gap in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(gap)) >= 0:
            return block[: at + len(gap)], block[at + len(gap) :]
    return block, b""


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(map(str, parts)))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, *lines]).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Refers:
    """The record whose payload a revisit stands for."""

    page: int
    record: str
    uri: str
    date: str


def uri_of(url: str) -> str:
    return url.replace(" ", "%20")


def convert(fields: dict[str, str], block: bytes, place: str, refers: Refers | None = None, own: str | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit if another record holds its payload. `own`: its digest, if known."""
    url, date = fields["url"], iso(fields["date"])
    http = split_http(block)
    own = own or digest(http[1] if http else block)
    headers = [("WARC-Record-ID", record_id(url, date, own, place)), ("WARC-Date", date)]
    if "archive" in fields:
        return warc_record([("WARC-Type", "warcinfo"), *headers, ("WARC-Filename", fields["archive"]), ("Content-Type", "text/plain")], block)
    headers += [("WARC-Target-URI", uri_of(url)), ("WARC-Payload-Digest", "sha1:" + own)]
    if fields["ip"] not in ("", "-", "0.0.0.0"):
        headers.append(("WARC-IP-Address", fields["ip"]))
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        headers += [("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To", refers.record), ("WARC-Refers-To-Target-URI", refers.uri), ("WARC-Refers-To-Date", refers.date)]
        # The format has no header for a page's number, by which the pages' table knows it.
        headers += [("WARC-Refers-To-Page", str(refers.page)), ("Content-Type", "application/http; msgtype=response")]
        return warc_record(headers, http[0] if http else b"")
    if http:
        return warc_record([("WARC-Type", "response"), *headers, ("Content-Type", "application/http; msgtype=response")], block)
    return warc_record([("WARC-Type", "resource"), *headers, ("Content-Type", fields["mime"] or "application/octet-stream")], block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; sums are checked."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.find(b"\r\n\r\n", at)
            if not member.startswith(b"WARC/1.", at) or end < 0:
                raise ValueError("not a WARC record")
            lines = member[at:end].decode().split("\r\n")[1:]
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
            size = int(headers["content-length"])
            block = member[end + 4 : end + 4 + size]
            if len(block) != size or headers["warc-block-digest"] != "sha1:" + digest(block):
                raise ValueError("a damaged record")
            yield headers, block
            at = end + 4 + size + 4


def http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode() if found else None


# --- Spark ----------------------------------------------------------------------------------------------------------


class _Files:
    """Gathers records and writes a file whenever enough are there."""

    def __init__(self, out: str, suffix: str, file_bytes: int) -> None:
        self.out, self.suffix, self.file_bytes = out, suffix, file_bytes
        self.shard, self.part, self.raw, self.rows, self.parts = TaskContext.get().partitionId(), 0, 0, 0, []

    @property
    def name(self) -> str:
        return f"{self.shard:07d}-{self.part:05d}{self.suffix}"

    def add(self, record: bytes, rows: int = 1) -> None:
        self.parts.append(deflate(record))
        self.raw += len(record)
        self.rows += rows

    def flush(self) -> pa.RecordBatch:
        shared.put(f"{self.out}/{self.name}", b"".join(self.parts))
        done = pa.record_batch({"file": [self.name], "n": pa.array([self.rows], pa.int64())})
        self.part, self.raw, self.rows, self.parts = self.part + 1, 0, 0, []
        return done

    @property
    def full(self) -> bool:
        return self.raw >= self.file_bytes


def write_arc(pages: DataFrame, out: str, date: str = "20040229123456", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC archives, in turn of version 1 and 2; the manifest (file, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(out, ".arc.gz", file_bytes)
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 1 + (files.shard + files.part) % 2
                if not files.parts:
                    files.add(arc_version_block(files.name, version, date), 0)
                body = (html or "").encode()
                tag = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{tag}\r\n".encode()
                files.add(arc_record(version, re.sub(r"[\r\n]", "", url) if url else f"urn:page:{page}", "192.0.2.1", date, "text/html", head + body, name=files.name, offset=files.raw))
                if files.full:
                    yield files.flush()
        if files.parts:
            yield files.flush()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return shared.kept(rows.mapInArrow(run, "file string, n long"), "arc")


_ARC = "file string, seq int, page_id long, place string, payload_digest string, url string, warc_date string"


def _each(spark: SparkSession, out: str, manifest: DataFrame, use, schema: str) -> DataFrame:
    """What `use(file, content)` yields of each file that the manifest lists, a task for each of them; what a lost task
    left behind is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                yield from use(file, shared.get(f"{out}/{file}"))

    files = manifest.select("file")
    return files.repartition(max(1, min(files.count(), 100_000)), "file").mapInArrow(run, schema)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read_arc(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives in the manifest, without the version blocks and without the records' bytes."""

    def use(file: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rows = []
        for seq, r in enumerate(parse_arc(content)):
            if "archive" in r.fields:
                continue
            head, payload = split_http(r.block) or (b"", r.block)
            page = http_field(head, "X-Page-Id")
            rows.append((file, seq, None if page is None else int(page), f"{file}@{r.offset}", digest(payload), r.fields["url"], iso(r.fields["date"])))
        yield _table(rows, _ARC)

    return _each(spark, out, manifest, use, _ARC)


_VERDICT = "seq int, payload_digest string, page long, record string, uri string, date string"


def write_warc(spark: SparkSession, arc: str, listed: DataFrame, out: str) -> DataFrame:
    """Converts the archives that `listed` lists to WARC archives; equal payloads are kept once. The manifest (file, n)."""
    records = shared.kept(read_arc(spark, arc, listed), "records")
    # Of rows that share the largest page_id, all are responses; revisits name the first of them.
    first = F.max(F.struct("page_id", (-F.xxhash64("place")).alias("turn"), "place", "url", "warc_date")).alias("first")
    largest = records.where("page_id IS NOT NULL").groupBy("payload_digest").agg(first)
    other = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    told = [F.when(other, F.col(f"first.{c}")).alias(n) for c, n in (("page_id", "page"), ("place", "place_"), ("url", "uri"), ("warc_date", "date"))]
    verdicts = records.join(largest, "payload_digest", "left").select("file", "seq", "payload_digest", *told)

    def put(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("seq", "payload_digest", "page", "place_", "uri", "date")), strict=True))
        file = table["file"][0].as_py()
        told = [(s, d, p, None if p is None else record_id(u, t, d, place), None if p is None else uri_of(u), t) for s, d, p, place, u, t in rows]
        sink = pa.BufferOutputStream()
        batch = _table(told, _VERDICT)
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        shared.put(f"{arc}/{file}.verdicts", sink.getvalue().to_pybytes())
        return pa.table({"file": pa.array([file])})

    shared.kept(verdicts.groupBy("file").applyInArrow(put, "file string"), "verdicts-done")

    def use(file: str, content: bytes) -> Iterator[pa.RecordBatch]:
        known = {r["seq"]: r for r in pa.ipc.open_stream(shared.get(f"{arc}/{file}.verdicts")).read_all().to_pylist()}
        parts = []
        for seq, r in enumerate(parse_arc(content)):
            verdict = known.get(seq)
            refers = Refers(verdict["page"], verdict["record"], verdict["uri"], verdict["date"]) if verdict and verdict["page"] is not None else None
            parts.append(deflate(convert(r.fields, r.block, f"{file}@{r.offset}", refers, verdict["payload_digest"] if verdict else None)))
        name = file.removesuffix(".arc.gz") + ".warc.gz"
        shared.put(f"{out}/{name}", b"".join(parts))
        yield _table([(name, len(parts))], "file string, n long")

    return shared.kept(_each(spark, arc, listed, use, "file string, n long"), "warc")


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string, refers_to_record string"


def read_warc(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """A row for each response and revisit in the archives of the manifest."""

    def use(_: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, block in parse_warc(content):
            kind = h["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            head, payload = split_http(block) or (b"", block)
            page, refers = http_field(head, "X-Page-Id"), h.get("warc-refers-to-page")
            own = h["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and digest(payload) != own:
                raise ValueError("a payload that differs from its digest")
            size = len(payload) if kind == "response" else int(http_field(head, "Content-Length") or 0)
            rows.append((None if page is None else int(page), size, own, kind, None if refers is None else int(refers), h["warc-target-uri"], h["warc-date"], h["warc-record-id"], h.get("warc-refers-to")))
        yield _table(rows, _PAGE)

    return _each(spark, out, manifest, use, _PAGE)


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC archives, those to WARC archives, and these read back."""
    spark = pages.sparkSession
    arc, warc = shared.folder(spark, "arc-files"), shared.folder(spark, "warc-files")
    listed = write_arc(pages, arc, file_bytes=file_bytes)
    if not listed.count():
        return spark.createDataFrame([], _PAGE)
    done = write_warc(spark, arc, listed, warc)
    shared.drop(spark, arc)
    return read_warc(spark, warc, done)
