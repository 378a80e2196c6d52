"""Legacy ARC archives to WARC.

An ARC file opens with a ``filedesc://`` record whose body names the version; the
fields of every later header line follow from it:

    1: url ip date type length
    2: url ip date type status checksum location offset filename length

A record's body is exactly its declared length, then one line end. The converter
reads records by these lengths from a stream that inflates as it goes, and gives
each a WARC identifier made from its place and content (so that reruns agree), a
WARC date from its date, a type, and SHA-1 digests in base32 of its payload and of
its block. Bodies are bytes from end to end: images and pages of any charset pass
unchanged. Types: ``filedesc`` becomes ``warcinfo``; a body with an HTTP header is a
``response``; any other (``dns:`` and the like) a ``resource`` under the ARC's content
type. Of responses with equal payloads the one of the smallest page id stays; the
others become revisits that refer to it and carry their HTTP header alone.

Archives are files that Spark's own writer makes (gzip; its commit protocol drops
what a lost executor left), rolled after ARCHIVE_CHUNKS chunks of CHUNK bytes, or of
one larger record.

Defined results: a null html is an empty payload; a null url is ``urn:none``;
white space in a url is percent-encoded; dates of 4 to 14 digits are filled up with
the first month, day and hour; null page ids come after all others and equal ones
are ordered by their place in the archives; payloads under ``min_bytes`` are always
responses; an empty table gives no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitfilter
from .common import staging_path, stash

#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Header lines: an address, a date and the length hold no space, so a url or a content type may.
ARC_LINES = {
    1: re.compile(rb"(.*) ([^ ]+) ([0-9]{4,14}) (.*) ([0-9]+)"),
    2: re.compile(rb"(.*) ([^ ]+) ([0-9]{4,14}) (.*) [^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+ ([0-9]+)"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20200101000000"
CHUNK = 1 << 20
ARCHIVE_CHUNKS = 64
#: Repeated payloads whose responses are broadcast (about 100 bytes each); beyond, records meet them by a join.
BROADCAST_KEYS = 200_000
_ROLLED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": ARCHIVE_CHUNKS}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _decoded(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _no_space(url: str) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and the payload; no header: empty, and all of it."""
    end = _HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    return (block[: end.end()], block[end.end() :]) if end else (b"", block)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    offset: int
    version: int
    archive: str = ""

    @property
    def kind(self) -> str:
        """The WARC type, repeated payloads apart."""
        return "warcinfo" if self.url.startswith("filedesc://") else "response" if split_http(self.block)[0] else "resource"


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 Ledgerline\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_record(f"filedesc://{name}", body, version, name, 0, "text/plain")


def arc_record(url: str, block: bytes, version: int, name: str, offset: int, content_type: str = "text/html", date: str = CAPTURED, ip: str = "0.0.0.0") -> bytes:
    """One ARC record, without the line end after it."""
    fields = [_no_space(url) or "urn:none", ip, date, content_type]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block


def page_block(html: bytes, page_id: int | None) -> bytes:
    """A page as an HTTP response that names it."""
    page = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {page}\r\n\r\n".encode() + html


def opened(content: pa.Scalar) -> BinaryIO:
    """An archive's bytes as a stream: gzip, of one or many members, is inflated as it is read."""
    raw = pa.BufferReader(content.as_buffer())
    zipped = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw)


def parse_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, ``filedesc`` included, by header lines and declared lengths.

    Raises ValueError where a header line does not have its version's fields or a
    length does not fit: a damaged archive is never read on by guessing.
    """
    at, version, archive = 0, 1, ""
    while line := _line(stream):
        start, at = at, at + len(line)
        if not line.strip(b"\r\n"):
            continue
        if line.startswith(b"filedesc://"):  # its own version stands in its body; either form of line may open it
            fields = next((m for m in (ARC_LINES[2].fullmatch(line.rstrip(b"\r\n")), ARC_LINES[1].fullmatch(line.rstrip(b"\r\n"))) if m), None)
        else:
            fields = ARC_LINES[version].fullmatch(line.rstrip(b"\r\n"))
        if not fields:
            raise ValueError(f"header line at {start} lacks the fields of version {version}")
        url, ip, date, kind, length = map(_decoded, fields.groups())
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ValueError(f"declared length {length} at {start} exceeds the archive")
        at += len(block)
        if url.startswith("filedesc://"):
            version, archive = int(block.split(None, 1)[0]), url.removeprefix("filedesc://")
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        yield ArcRecord(url, ip, date, kind, block, start, version, archive)


def _line(stream: BinaryIO) -> bytes:
    line = stream.readline()
    if line and not line.endswith(b"\n"):
        raise ValueError(f"header line without end: {line[:80]!r}")
    return line


def warc_date(arc_date: str) -> str:
    """The date in full: what is missing, or a month or day of 00, is the first."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(record: ArcRecord, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{record.archive} {record.offset} {record.url} {record.date} {digest}')}"


def warc_record(record: ArcRecord, identity: str, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, without the two line ends after it."""
    kind = "revisit" if refers_to else record.kind
    block = split_http(record.block)[0] if refers_to else record.block
    if kind == "warcinfo":
        block = f"software: Ledgerline\r\nformat: WARC File Format 1.1\r\ndescription: converted from {record.archive}, ARC version {record.version}\r\n".encode()
        kinds = ["application/warc-fields"]
    else:
        kinds = ["application/http; msgtype=response"] if kind != "resource" else [record.content_type or "application/octet-stream"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>", f"WARC-Date: {warc_date(record.date)}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {record.archive}")
    else:
        lines += [f"WARC-Target-URI: {_no_space(record.url)}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind in ("response", "revisit"):
        lines.append(f"WARC-Identified-Payload-Type: {record.content_type}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {kinds[0]}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, by its Content-Length."""
    while line := _line(stream):
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC header: {line[:80]!r}")
        header: dict[str, str] = {}
        while (line := _line(stream)).strip():
            key, _, value = line.decode("utf-8", "surrogatepass").strip().partition(": ")
            header[key.lower()] = value
        block = stream.read(int(header["content-length"]))
        if len(block) != int(header["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {header.get('warc-record-id')} does not end where its length says")
        yield header, block


def http_fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def _batched(rows: Iterator[tuple], schema: pa.Schema, size_of, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size > most or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunks(records: Iterator[bytes], between: bytes) -> Iterator[tuple[bytes]]:
    """Records joined to rows of CHUNK bytes; one larger record is a row of its own."""
    held: list[bytes] = []
    size = 0
    for record in records:
        held.append(record)
        size += len(record) + len(between)
        if size >= CHUNK:
            yield (between.join(held),)
            held, size = [], 0
    if held:
        yield (between.join(held),)


def _write(chunks: DataFrame, path: str, between: str) -> None:
    """Rows of bytes as they are: a cast to string changes none."""
    chunks.select(F.col("value").cast("string")).write.options(**_ROLLED).option("lineSep", between).text(path)


_VALUE = pa.schema([("value", pa.binary())])


def write_arcs(pages: DataFrame, path: str) -> None:
    """ARC archives of ``pages`` (page_id, url, html), of either version by turns."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))

        def archives() -> Iterator[tuple[bytes]]:
            """Each archive is ARCHIVE_CHUNKS rows, so that the writer's files and the archives are one."""
            chunk: list[bytes] = []
            n, size, offset, name = 0, 0, 0, ""
            for page_id, url, html in rows:
                if not n % ARCHIVE_CHUNKS and not chunk:
                    name = f"pages-{part:05d}-{n // ARCHIVE_CHUNKS:05d}.arc"
                    chunk = [arc_version_block(name, version)]
                    size = offset = len(chunk[0]) + 1
                chunk.append(arc_record(url or "urn:none", page_block((html or "").encode("utf-8", "surrogatepass"), page_id), version, name, offset))
                size, offset = size + len(chunk[-1]) + 1, offset + len(chunk[-1]) + 1
                if size >= CHUNK:
                    yield (b"\n".join(chunk),)
                    n, chunk, size = n + 1, [], 0
            if chunk:
                yield (b"\n".join(chunk),)

        yield from _batched(archives(), _VALUE, lambda r: len(r[0]))

    _write(pages.select("page_id", "url", "html").mapInArrow(written, "value binary"), path, "\n")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,arc,warc}*").load(path).select("content")


def read_arcs(spark: SparkSession, path: str, with_records: bool = True) -> DataFrame:
    """The converter's first half: every ARC record with its WARC identity.

    page_id, record_id, digest, payload_bytes, kind, and (with_records) the
    record's fields as the second half needs them.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("kind", pa.string())])
    full = pa.schema([*schema, ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("version", pa.int32()), ("archive", pa.string()), ("block", pa.binary())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    for r in parse_arc(opened(content)):
                        head, payload = split_http(r.block)
                        digest, page = sha1_base32(payload), http_fields(head).get("x-page-id", "")
                        row = (int(page) if page else None, record_id(r, digest), digest, len(payload), r.kind)
                        yield (*row, r.url, r.ip, r.date, r.content_type, r.version, r.archive, r.block) if with_records else row

        yield from _batched(rows(), full if with_records else schema, lambda r: len(r[-1]) if with_records else 64)

    columns = "page_id long, record_id string, digest string, payload_bytes long, kind string"
    return _archives(spark, path).mapInArrow(parsed, columns + (", url string, ip string, date string, content_type string, version int, archive string, block binary" if with_records else ""))


def convert(spark: SparkSession, arcs: str, warcs: str, min_bytes: int = 0, most_keys: int = BROADCAST_KEYS) -> None:
    """ARC archives under ``arcs`` to WARC archives under ``warcs``.

    What refers to what is decided on an index of narrow rows. The responses of
    repeated payloads are broadcast up to ``most_keys`` of them, and then no body
    moves. Beyond, only records whose payload digest may occur twice meet their
    response by a join; a filter of bounded size lets the others pass where they are.
    """
    index = stash(read_arcs(spark, arcs, with_records=False), "arc-index").where((F.col("payload_bytes") >= min_bytes) & (F.col("kind") == "response"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first")
    again = stash(index.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.record_id").alias("response_id")), "arc-again")
    keys = again.count()
    records = read_arcs(spark, arcs)
    may_repeat = (F.col("payload_bytes") >= min_bytes) & (F.col("kind") == "response")
    if keys <= most_keys:
        met = records.join(F.broadcast(again), "digest", "left")
    else:
        log2_bits = bitfilter.bits_for(keys)
        table = stash(bitfilter.build(again.select(F.xxhash64("digest").alias("key")), "key", log2_bits), "arc-filter")
        records = bitfilter.flagged(records, F.xxhash64("digest"), table, "again", log2_bits)
        alone = records.where(~(F.col("again") & may_repeat)).withColumn("response_id", F.lit(None).cast("string"))
        met = alone.unionByName(records.where(F.col("again") & may_repeat).join(again, "digest", "left"))
    refers_to = F.when(may_repeat & (F.col("response_id") != F.col("record_id")), F.col("response_id"))
    every = met.select("record_id", "digest", refers_to.alias("refers_to"), "url", "ip", "date", "content_type", "version", "archive", "block")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for identity, digest, refers_to, url, ip, date, content_type, version, archive, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield warc_record(ArcRecord(url, ip, date, content_type, block, 0, version, archive), identity, digest, refers_to)

        yield from _batched(_chunks(records(), b"\r\n\r\n"), _VALUE, lambda r: len(r[0]))

    _write(every.mapInArrow(written, "value binary"), warcs, "\r\n\r\n")


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Every record of WARC archives but ``warcinfo``: page_id, record_id, type, content type, digest, refers_to_id, payload_bytes.

    The length and digest of a response or resource are computed from its payload
    and must equal its header's; a revisit has no payload, and null bytes.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("target_uri", pa.string()), ("warc_date", pa.string())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    for header, block in parse_warc(opened(content)):
                        kind = header["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = header["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and sha1_base32(payload) != digest:
                            raise ValueError(f"payload digest of {header['warc-record-id']}")
                        page, refers = http_fields(head).get("x-page-id", ""), header.get("warc-refers-to")
                        content_type = header.get("warc-identified-payload-type", header["content-type"])
                        yield int(page) if page else None, header["warc-record-id"][1:-1], kind, content_type, digest, refers and refers[1:-1], None if kind == "revisit" else len(payload), header["warc-target-uri"], header["warc-date"]

        yield from _batched(rows(), schema, lambda r: 256)

    columns = "page_id long, record_id string, record_type string, content_type string, payload_digest string, refers_to_id string, payload_bytes long, target_uri string, warc_date string"
    return _archives(spark, path).mapInArrow(parsed, columns)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` (stored) with ``refers_to``, the page of a revisit's response, whose payload's length is its own too."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    return records.join(responses, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def convert_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC archives, as read back, with the page that a revisit refers to."""
    arcs, warcs = staging_path(spark, "arc"), staging_path(spark, "warc")
    write_arcs(pages, arcs)
    convert(spark, arcs, warcs, min_bytes)
    return resolved(stash(read_warcs(spark, warcs), "warc-records"))
