"""spark.read.format("fasta"): byte ranges of each file as partitions, headers alone where only they are asked for; and its writer.

    spark.dataSource.register(FastaSource)
    spark.read.format("fasta").option("headersOnly", True).load("/data/in")      # (file, ord, header)
    spark.read.format("fasta").option("splitBytes", 1 << 20).load("/data/x.fasta")  # (file, ord, header, seq)
    rows.select("header", "seq").write.format("fasta").mode("append").option("lineWidth", 80).save("/data/out")

A record belongs to the partition in which its > stands; its task reads on to the next record's >. ``ord`` is
the byte at which the record begins, so (file, ord) is the order of the records. Files are reached as pyarrow reaches them
(local and shared folders, s3, gs, hdfs); ``fasta.read_fasta`` reads whatever Spark itself can open. Files that end in .gz,
.bz2 or .zst are one partition each.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of one partition, and the rows and bytes after which a task hands a batch on.
SPLIT, ROWS, BYTES = 64 << 20, 2000, 8 << 20
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files under a folder by name; names that begin with _ or . don't count."""
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    inside = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and not any(p[:1] in "_." for p in posixpath.relpath(f.path, at).split("/"))]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + p, n) for p, n in inside)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def scanned(stream: io.BufferedIOBase, start: int, end: int, whole: bool) -> Iterator[tuple[int, str, str]]:
    """(offset, header, seq) of records whose > stands in start to end; text before the first > is left out."""
    at = start
    if start:  # a line that began earlier belongs to the range before
        stream.seek(start - 1)
        at += len(stream.readline()) - 1
    opened, header, parts = None, "", []
    while at < end or (opened is not None and whole):
        line = stream.readline()
        if not line:
            break
        if line[:1] == b">":
            if opened is not None:
                yield opened, header, "".join(parts)
                opened = None
            if at >= end:
                return
            opened, header, parts = at, line[1:].rstrip(b"\r\n").decode("utf-8", "replace"), []
        elif opened is not None and whole:
            parts.append("".join(line.decode("utf-8", "replace").split()))
        at += len(line)
    if opened is not None:
        yield opened, header, "".join(parts)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict, whole: bool):  # names of options in small letters
        self.path, self.whole = options["path"], whole
        self.split = max(1, int(options.get("splitbytes", SPLIT)))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_of(self.path):
            if posixpath.splitext(path)[1] in PACKED:
                out.append(Range(path, 0, 1 << 62))
            else:
                out += [Range(path, k, min(k + self.split, size)) for k in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, at = located(partition.path)
        how = PACKED.get(posixpath.splitext(at)[1])
        opened = fs.open_input_stream(at, compression=how) if how else fs.open_input_file(at)
        names = ["file", "ord", "header"] + (["seq"] if self.whole else [])
        types = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("header", pa.string()), ("seq", pa.string())][: len(names)])
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            cols = [[partition.path] * len(held), *([r[k] for r in held] for k in range(len(names) - 1))]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, types, strict=True)], schema=types)

        with io.BufferedReader(opened, 1 << 20) as stream:
            for record in scanned(stream, partition.start, partition.end, self.whole):
                held.append(record)
                size += len(record[1]) + len(record[2])
                if len(held) >= ROWS or size >= BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class FastaWriter(DataSourceWriter):
    """One file for each task, written under a name of its own attempt and moved into place when the whole job has succeeded."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.width = options["path"].rstrip("/"), overwrite, int(options.get("linewidth", 0))
        self.job = uuid.uuid4().hex

    def _staged(self) -> tuple[pafs.FileSystem, str, str]:
        fs, at = located(self.path)
        return fs, at, f"{at}/_staged-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        fs, _, staged = self._staged()
        number = TaskContext.get().partitionId()
        name, first = f"part-{number:05d}-{uuid.uuid4().hex}.fasta", next(iterator, None)
        if first is None:
            return Part(None)
        fs.create_dir(staged, recursive=True)
        with fs.open_output_stream(f"{staged}/{name}") as out, io.BufferedWriter(out, 1 << 20) as lines:
            row = first
            while row is not None:
                header, seq = row["header"] or "", row["seq"] or ""
                if "\n" in header or "\r" in header:
                    raise ValueError(f"a header of several lines: {header!r}")
                folded = [seq[k : k + self.width] for k in range(0, len(seq), self.width)] if self.width else [seq]
                lines.write((">" + header + "\n" + "\n".join(folded or [""]) + "\n").encode())
                row = next(iterator, None)
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        fs, at, staged = self._staged()
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.path.rstrip("/") != staged:
                    (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        for part in messages:
            if part is not None and part.name:
                fs.move(f"{staged}/{part.name}", f"{at}/{part.name}")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, _, staged = self._staged()
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)


class FastaSource(DataSource):
    """Options: path; headersOnly (false): no sequences; splitBytes (64 MB); for writing lineWidth (0: one line a sequence)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def _whole(self) -> bool:
        return str(self.options.get("headersOnly", "false")).lower() != "true"

    def schema(self) -> str:
        return "file string, ord long, header string" + (", seq string" if self._whole() else "")

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(dict(self.options), self._whole())

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        if not {"header", "seq"} <= set(schema.fieldNames()):
            raise ValueError(f"header and seq are needed, there are {schema.fieldNames()}")
        return FastaWriter(dict(self.options), overwrite)
