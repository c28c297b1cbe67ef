"""Files that hold records across lines, or members, read by many tasks each.

CSV: a line break may stand in quotes, so where a record begins depends on all before it. Every stretch of a file that a task reads
is judged for both cases, that it starts inside quotes and that it doesn't; the stretches of a file, one row each, are then
combined from the front, which says what holds and on which line the record began that is still open.
Records inside a stretch are parsed where they are; only pieces of those that stretches cut are joined.

ZIP: the central directory says where members are, so a task reads some members and nothing else of the file. Members are unpacked
as they are read, in pieces, so a task's memory does not depend on their size.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.session import importable

#: Rows of an Arrow batch, and bytes that are unpacked or written at once.
ROWS, PIECE = 1000, 1 << 20
#: Compressed bytes of the members that one task reads, about; a larger member is a task of its own.
TASK_BYTES = 32 << 20


# --- CSV -------------------------------------------------------------------------------------------------------


_FIELD_ENDS = re.compile("[,\r]")


def height(line: str) -> int:
    """The lines that a stretch up to a line feed counts as: a carriage return alone ends one too."""
    return 1 + line.count("\r", 0, max(0, len(line) - 1))


def leaves_open(line: str, inside: bool) -> bool:
    """Whether the line ends inside quotes, if it starts inside or outside them. Quotes count only at the start of a field."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):  # a doubled quote is one character
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        end = _FIELD_ENDS.search(line, at)
        if end is None:
            return False
        at = end.end()


def _runs(it: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple[tuple, list[str], bool]]:
    """((path, block, extra), some of its lines, whether they are its last) of stretches in order."""
    now, held = None, []
    for batch in it:
        columns = [batch.column(c).to_pylist() for c in ("path", "block", *extra)]
        for key, line in zip(zip(*columns), batch.column("value").to_pylist()):
            if key != now and now is not None:
                yield now, held, True
                held = []
            elif len(held) >= ROWS:
                yield now, held, False
                held = []
            now = key
            held.append(line)
    if now is not None:
        yield now, held, True


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a stretch: its lines, and for either case whether it ends inside quotes and at which of its lines the open record began (-1: before it)."""
    lines, state, begun = 0, [False, True], [0, -1]
    for (path, block), some, last in _runs(it):
        for line in some:
            for case in (0, 1):
                if not state[case]:
                    begun[case] = lines
                state[case] = leaves_open(line, state[case])
            lines += height(line)
        if last:
            row = [path, block, lines, state, begun]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64())))], names=["path", "block", "lines", "ends", "begun"])
            lines, state, begun = 0, [False, True], [0, -1]


def _combined(blocks: pa.Table) -> pa.Table:
    """Of a file's stretches: the lines before each, whether it starts inside quotes, and the line of the record that is then open."""
    blocks, before, inside, open_at, out = blocks.sort_by("block"), 0, False, 0, []
    for n, ends, begun in zip(*(blocks[c].to_pylist() for c in ("lines", "ends", "begun"))):
        out.append((before, inside, open_at))
        case = int(inside)
        open_at = before + begun[case] + 1 if begun[case] >= 0 else open_at
        before, inside = before + n, ends[case]
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int64()))]
    return pa.table([blocks["path"], blocks["block"], *columns], names=["path", "block", "before", "inside", "open_at"])


def parsed(record: str) -> list[tuple[int, list[str]]]:
    """The records of a text, each with the number of lines before it; one, but where carriage returns part them."""
    csv.field_size_limit(sys.maxsize)
    reader, out, before = csv.reader(io.StringIO(record, newline="")), [], 0
    for fields in reader:
        out.append((before, fields))
        before = reader.line_num
    return out or [(0, [])]


_RECORDS = "path string, line bigint, piece bigint, fields array<string>, text string"


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records with their fields; of records that the stretch's edges cut, the text of the piece, numbered by its first line."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "line", "piece", "fields", "text"])
        rows.clear()
        return out

    fresh, held = True, []
    for (path, _, before, inside, open_at), some, last in _runs(it, "before", "inside", "open_at"):
        if fresh:
            number, tall, open_, whole, start, first, held = before, 1, inside, not inside, open_at, before + 1, []
        for line in some:
            number, tall = number + tall, height(line)
            line = line.removeprefix("﻿") if number == 1 else line
            if not held:
                first = number
                start = number if whole else start
            held.append(line)
            open_ = leaves_open(line, open_)
            if not open_:
                text = "\n".join(held)
                rows += [(path, start + n, first, fields, None) for n, fields in parsed(text)] if whole else [(path, start, first, None, text)]
                held, whole = [], True
            if len(rows) >= ROWS:
                yield batch()
        if last and held:
            rows.append((path, start, first, None, "\n".join(held)))
        fresh = last
    if rows:
        yield batch()


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fields): every CSV record, header included, with the line that it starts on, from 1, by many tasks a file.

    Lines end with line feeds, carriage returns or both; quotes count at the start of a field, doubled ones inside
    are one; a record whose quotes are never closed ends with the file; an empty line is a record without fields. A byte order mark is no text. Gzipped
    files are unpacked by one task each.
    """
    importable(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    judged = lines.mapInArrow(_judged, "path string, block bigint, lines bigint, ends array<boolean>, begun array<bigint>")
    # a gzipped file's one stretch may come in several batches, never in several tasks
    edges = judged.groupBy("path").applyInArrow(_combined, "path string, block bigint, before bigint, inside boolean, open_at bigint")
    marked = lines.withColumn("at", F.monotonically_increasing_id()).join(edges, ["path", "block"]).sortWithinPartitions("path", "block", "at")
    found = marked.select("path", "block", "before", "inside", "open_at", "value").mapInArrow(_cut, _RECORDS)
    pieces = found.where("fields IS NULL").groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("pieces"))
    joined = pieces.select("path", "line", F.array_join(F.col("pieces.text"), "\n").alias("text")).mapInArrow(_parsed, "path string, line bigint, fields array<string>")
    return found.where("fields IS NOT NULL").select("path", "line", "fields").unionByName(joined)


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [(p, line + n, fields) for p, line, text in zip(*(c.to_pylist() for c in batch.columns)) for n, fields in parsed(text)]
        types = (pa.string(), pa.int64(), pa.list_(pa.string()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, types)], names=["path", "line", "fields"])


# --- ZIP -------------------------------------------------------------------------------------------------------


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and place of a path or URI, file:/x included."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _File(io.RawIOBase):
    """An Arrow file with the errors of a Python one, which zipfile asks for."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("a place before the file")
        return self.file.seek(at)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _archives(path: str) -> list[str]:
    """The path, or the .zip files in it if it is a folder."""
    system, place = _opened(path)
    if system.get_file_info(place).type != pafs.FileType.Directory:
        return [path]
    found = system.get_file_info(pafs.FileSelector(place))
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{f.base_name}" for f in found if f.is_file and f.base_name.endswith(".zip"))


@dataclass
class Members(InputPartition):
    """Some members of one archive: (name, place of the local header, compressed size, method, checksum)."""

    path: str
    members: list[tuple[str, int, int, int, int]]


class ZipLines(DataSource):
    """Lines of the members of ZIP archives: spark.read.format("zip_lines").option("suffix", ".jsonl").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "path string, member string, line bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix, self.task_bytes = options["path"], options.get("suffix", ""), int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[Members]:
        out = []
        for path in _archives(self.path):
            system, place = _opened(path)
            with system.open_input_file(place) as file, zipfile.ZipFile(_File(file)) as archive:
                held, size = [], 0
                for m in sorted(archive.infolist(), key=lambda m: m.header_offset):
                    if m.is_dir() or not m.filename.endswith(self.suffix):
                        continue
                    if held and size + m.compress_size > self.task_bytes:
                        out.append(Members(path, held))
                        held, size = [], 0
                    held.append((m.filename, m.header_offset, m.compress_size, m.compress_type, m.CRC))
                    size += m.compress_size
                if held:
                    out.append(Members(path, held))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        system, place = _opened(partition.path)
        with system.open_input_file(place) as file:
            for name, offset, size, method, checksum in partition.members:
                rows: list[tuple[int, str]] = []
                for number, line in enumerate(_lines(_unpacked(file, name, offset, size, method, checksum)), 1):
                    rows.append((number, line))
                    if len(rows) >= ROWS:
                        yield self.batch(partition.path, name, rows)
                        rows = []
                if rows:
                    yield self.batch(partition.path, name, rows)

    def batch(self, path: str, name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.record_batch([pa.array([path] * n), pa.array([name] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["path", "member", "line", "text"])


def _unpacked(file, name: str, offset: int, size: int, method: int, checksum: int) -> Iterator[bytes]:
    """A member's bytes in pieces; ValueError if it is stored in a way that is not known, or damaged."""
    file.seek(offset)
    head = struct.unpack("<4s5H3I2H", file.read(30))
    if head[0] != b"PK\x03\x04" or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or head[2] & 1:
        raise ValueError(f"{name} cannot be read")
    file.seek(offset + 30 + head[-2] + head[-1])
    unpack, found, left = zlib.decompressobj(-15), 0, size
    while left:
        piece = file.read(min(PIECE, left))
        if not piece:
            raise ValueError(f"{name} is cut off")
        left -= len(piece)
        while piece:
            out = piece if method == zipfile.ZIP_STORED else unpack.decompress(piece, PIECE)
            piece = b"" if method == zipfile.ZIP_STORED else unpack.unconsumed_tail
            found = zlib.crc32(out, found)
            yield out
    out = unpack.flush() if method == zipfile.ZIP_DEFLATED else b""
    found = zlib.crc32(out, found)
    if found != checksum:
        raise ValueError(f"{name} is damaged")
    yield out


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    held: list[bytes] = []
    for piece in pieces:
        first, *rest = piece.split(b"\n")
        held.append(first)
        for line in rest:
            yield b"".join(held).removesuffix(b"\r").decode()
            held = [line]
    if any(held):
        yield b"".join(held).removesuffix(b"\r").decode()


def read_zip_lines(spark: SparkSession, path: str, suffix: str = "", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, member, line, text): the lines of the members, with names that end in `suffix`, of one archive or of the .zip files in a folder.

    Paths are local ones or those of a store that Arrow opens. Members may be stored or deflated; a damaged one raises.
    """
    importable(spark)
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(suffix=suffix, task_bytes=task_bytes).load(path)


def write_zip(df: DataFrame, path: str, member: str, text: str) -> None:
    """An archive for each of df's partitions in the folder `path`: rows of a member follow each other as its lines.

    Rows must be sorted by member within partitions. An archive is moved to its place when it is whole, under a name that its partition
    gives, so a task that runs again replaces it.
    """
    importable(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = _opened(path)
        system.create_dir(place, recursive=True)
        final = f"{place}/part-{TaskContext.get().partitionId():05d}.zip"
        beside, now, stream, n = f"{final}.{uuid.uuid4().hex}", None, None, 0
        with system.open_output_stream(beside) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in it:
                for name, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if name != now:
                        if stream:
                            stream.close()
                        now, stream = name, archive.open(name, "w", force_zip64=True)
                    stream.write(line.encode() + b"\n")
                    n += 1
            if stream:
                stream.close()
        system.move(beside, final)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    df.select(member, text).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
