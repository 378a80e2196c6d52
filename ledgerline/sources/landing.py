"""Raw HTTP responses in a landing folder: a data source for batches and streams, and its sink.

A fetcher has a folder of its own under the landing folder and puts finished files into it
by rename, with names that ascend. So a stream's offset is the last name of each fetcher:
no file is met twice, and none is passed over because another fetcher was faster. A file
holds responses one after the other: a line of JSON (url, attempt, fetched_at, length) and
``length`` bytes as they came from the wire: status line, header, body. Length 0 says that
nothing came.

    register(spark)
    spark.readStream.format("landed_responses").load("/data/landing")
    df.write.format("landed_responses").option("fetcher", "a").mode("append").save("/data/landing")

Reading gives the columns of ``readers.LANDED``; writing takes url, attempt, fetched_at and
response (binary). Responses that cannot be read (cut short, no status line) have no
status, as if nothing had come: a failure that is tried again. A file that breaks off is
read up to there.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from http.client import HTTPException, HTTPResponse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .readers import LANDED

ENDING = ".responses"
#: Bytes of files that one task reads, and after which a task that writes begins a new file.
LOT_BYTES = 64 << 20
#: Bytes of the bodies of one batch of rows.
BATCH_BYTES = 8 << 20

_ROWS = pa.schema([("url", pa.string()), ("attempt", pa.int32()), ("status", pa.int32()), ("charset", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("body", pa.binary()), ("fetched_at", pa.timestamp("us", tz="UTC"))])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


class _Wire:
    """Bytes in the place of a socket."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def makefile(self, mode: str) -> io.BytesIO:
        return io.BytesIO(self.raw)


def parsed(raw: bytes) -> tuple:
    """(status, charset, etag, last_modified, body) of a response as it came; all null where it cannot be read."""
    if raw[:6] in (b"HTTP/2", b"HTTP/3"):
        raw = b"HTTP/1.1" + raw[raw.find(b" ") :]
    try:
        response = HTTPResponse(_Wire(raw))
        response.begin()
        body = response.read()
        packed = (response.getheader("Content-Encoding") or "").strip().lower()
        if packed in ("gzip", "x-gzip", "deflate") and body:
            whole = zlib.decompressobj(47)
            body = whole.decompress(body) + whole.flush()
            if not whole.eof:
                return None, None, None, None, None
        return response.status, response.headers.get_content_charset(), response.getheader("ETag"), response.getheader("Last-Modified"), body
    except (HTTPException, ValueError, zlib.error):
        return None, None, None, None, None


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """The responses of a file, one at a time."""
    while line := stream.readline():
        try:
            head = json.loads(line)
            raw = stream.read(head["length"])
        except (ValueError, KeyError, TypeError):
            return
        if len(raw) < head["length"]:
            return
        yield head, raw


@dataclass
class Lot(InputPartition):
    paths: list[str]


class _Files:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.path, self.lot_bytes = options["path"], int(options.get("lotbytes", LOT_BYTES))

    def fetchers(self) -> list[str]:
        system, root = _opened(self.path)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))

    def files(self, fetcher: str) -> list[fs.FileInfo]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/{fetcher}"))
        return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(ENDING) and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def lots(self, files: list[fs.FileInfo]) -> list[Lot]:
        """Small files together, up to the bytes of a lot."""
        out, held = [], 0
        for f in files:
            if not out or held + f.size > self.lot_bytes:
                out.append(Lot([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, lot: Lot) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        rows, held = [], 0
        for path in lot.paths:
            with system.open_input_stream(path) as stream, io.BufferedReader(stream) as lines:
                for head, raw in records(lines):
                    at = datetime.fromisoformat(head["fetched_at"]) if head.get("fetched_at") else None
                    rows.append((head.get("url"), head.get("attempt"), *parsed(raw), at))
                    held += len(rows[-1][6] or b"")
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


class Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Lot]:
        return self.lots([f for name in self.fetchers() for f in self.files(name)]) or [Lot([])]


class Offsets(_Files, DataSourceStreamReader):
    """An offset is the last name of each fetcher: {fetcher: name}."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {name: self.files(name) for name in self.fetchers()}
        return {name: files[-1].base_name for name, files in found.items() if files}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        return self.lots([f for name, last in sorted(end.items()) for f in self.files(name) if start.get(name, "") < f.base_name <= last])


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Sink(DataSourceArrowWriter):
    """Tasks write aside; the commit renames their files into the fetcher's folder, in order. A fetcher writes once at a time."""

    def __init__(self, options: dict, schema: StructType):
        lacking = {"url", "attempt", "fetched_at", "response"} - set(schema.names)
        if lacking:
            raise ValueError(f"landed responses need {', '.join(sorted(lacking))}")
        self.path, self.fetcher, self.roll = options["path"], options.get("fetcher", "main"), int(options.get("lotbytes", LOT_BYTES))
        if not self.fetcher or self.fetcher.startswith(("_", ".")) or "/" in self.fetcher:
            raise ValueError(f"a fetcher's name is a folder's, without a leading mark: {self.fetcher!r}")
        self.aside = f"_pending/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        paths, out = [], None
        try:
            for batch in iterator:
                for url, attempt, at, raw in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("url", "attempt", "fetched_at", "response")], strict=True):
                    if out is None or out.tell() >= self.roll:
                        if out is not None:
                            out.close()
                        paths.append(f"{root}/{self.aside}/{uuid.uuid4().hex}")
                        out = system.open_output_stream(paths[-1])
                    raw = raw or b""
                    stated = None if at is None else (at if at.tzinfo else at.replace(tzinfo=UTC)).isoformat()
                    out.write(json.dumps({"url": url, "attempt": attempt, "fetched_at": stated, "length": len(raw)}).encode() + b"\n" + raw)
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        home = f"{root}/{self.fetcher}"
        system.create_dir(home, recursive=True)
        before = [f.base_name for f in system.get_file_info(fs.FileSelector(home)) if f.base_name.endswith(ENDING)]
        turn = int(max(before).split("-")[0]) + 1 if before else 0
        for n, path in enumerate(p for m in messages if m for p in m.paths):
            system.move(path, f"{home}/{turn:012d}-{n:06d}{ENDING}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _opened(self.path)
        if system.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class LandedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema: StructType) -> Offsets:  # noqa: N802
        return Offsets(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Sink:
        if overwrite:
            raise ValueError("a landing folder is only added to")
        return Sink(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(LandedResponses)
