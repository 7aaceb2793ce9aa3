"""Zip archives as a data source: a row for each member, read by ranges of members, and a sink that writes an archive a task.

    register(spark)
    spark.read.format("archive").load(path)         archive, member, size, content, error
    df.write.format("archive").mode(...).save(path) from the columns member and content

path: an archive or a folder of them, a local path or a URI that Arrow's file systems know. Planning reads the archives' directories only.
Consecutive members go to a task until they hold `partitionBytes` compressed bytes, and a task reads just its members' bytes, so a large
archive is read by many. Filters on member, archive and size are applied while planning: other members' bytes aren't touched.
Option content=false leaves the bytes unread. An archive or a member that can't be read is a row with its error and without content.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

SCHEMA = "archive string, member string, size long, content binary, error string"
ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Compressed bytes of a task, bytes of content in a batch.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 8 << 20

_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Member:
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    flags: int


@dataclass
class Range(InputPartition):
    """Consecutive members of an archive, or why it has none."""

    archive: str
    members: list[Member]
    error: str | None = None

    def __post_init__(self):
        super().__init__(self.archive)


def unpacked(source, m: Member) -> bytes:
    """A member's content, by its own header and the directory's sizes; checked against its sum."""
    if m.flags & 1:
        raise ValueError("encrypted")
    source.seek(m.offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no header at its offset")
    source.seek(m.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = source.read(m.packed)
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"method {m.method} is unknown")
    content = raw if m.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if len(content) != m.size or zlib.crc32(content) != m.crc:
        raise ValueError("its sum is wrong")
    return content


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, limit: int, content: bool):
        self.path, self.limit, self.content = path, limit, content
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", ()) else None
            if type(f) in _TESTS and column in ("member", "archive", "size"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def wanted(self, archive: str, m: Member) -> bool:
        of = {"archive": archive, "member": m.name, "size": m.size}
        return all(_TESTS[kind](of[column], value) for column, kind, value in self.tests)

    def partitions(self) -> list[Range]:
        system, path = store(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [path] if info.is_file else sorted(f.path for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(".zip") and "/_pending-" not in f.path)
        out = []
        for archive in files:
            try:
                with system.open_input_file(archive) as source, zipfile.ZipFile(source) as z:
                    members = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits) for i in z.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                if not any(column != "archive" or not _TESTS[kind](archive, value) for column, kind, value in self.tests):
                    out.append(Range(archive, [], f"{type(e).__name__}: {e}"))
                continue
            held: list[Member] = []
            size = 0
            for m in members:
                if not self.wanted(archive, m):
                    continue
                if held and size + m.packed > self.limit:
                    out.append(Range(archive, held))
                    held, size = [], 0
                held.append(m)
                size += m.packed
            if held:
                out.append(Range(archive, held))
        return out or [Range("", [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.error:
            yield pa.RecordBatch.from_arrays([pa.array([part.archive]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([part.error])], schema=ARROW)
        if not part.members:
            return
        system, _ = store(self.path)
        with system.open_input_file(part.archive) as source:
            rows: list[tuple] = []
            size = 0
            for m in part.members:
                content = error = None
                if self.content:
                    try:
                        content = unpacked(source, m)
                    except (ValueError, zlib.error, struct.error, OSError) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append((part.archive, m.name, m.size, content, error))
                size += len(content or b"")
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """Tasks write to a folder of the job's own; committing moves what the successful attempts wrote into place, so a failed or repeated attempt leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.pending = f"{store(path)[1].rstrip('/')}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _ = store(self.path)
        system.create_dir(self.pending, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"
        n = 0
        with system.open_output_stream(f"{self.pending}/{name}") as sink, zipfile.ZipFile(_Sequential(sink), "w", zipfile.ZIP_DEFLATED) as z:
            for b in iterator:
                for member, content in zip(b.column("member").to_pylist(), b.column("content").to_pylist()):
                    if member is not None:
                        z.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
                        n += 1
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(path)):
                if f.is_file and f.path.endswith(".zip"):
                    system.delete_file(f.path)
        for m in messages:
            if m and m.name:
                system.move(f"{self.pending}/{m.name}", f"{path.rstrip('/')}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = store(self.path)
        if system.get_file_info(self.pending).type == pafs.FileType.Directory:
            system.delete_dir(self.pending)


class _Sequential(io.RawIOBase):
    """An output stream that tells how much was written, which is all that writing an archive front to back needs."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        if not self.sink.closed:
            self.sink.flush()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), self.options.get("content", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if not {"member", "content"} <= set(schema.names):
            raise ValueError("an archive is written from the columns member and content")
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
