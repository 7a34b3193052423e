"""Text members of ZIP archives as a data source that tasks share: a partition per member and range of bytes."""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, line bigint, value string"
#: Uncompressed bytes of a partition, lines of a batch, bytes that are skipped at a time.
RANGE_BYTES, BATCH_LINES, SKIP_BYTES = 64 << 20, 50_000, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a member that begin in [start, end) of its uncompressed bytes."""

    archive: str
    member: str
    start: int
    end: int


def archives(path: str) -> list[str]:
    """Files that a path names: one file, the files of a folder, or those that match a pattern in the last part."""
    files, at = fs.FileSystem.from_uri(path)
    folder, _, name = at.rpartition("/")
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in name for c in "*?["):
        found = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
    elif files.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    else:
        found = [at]
    return [scheme + f for f in sorted(found)]


def _opened(archive: str) -> zipfile.ZipFile:
    files, at = fs.FileSystem.from_uri(archive)
    return zipfile.ZipFile(files.open_input_file(at))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.wanted = options["path"], options.get("member", "")
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """From the archives' lists of members alone."""
        out = []
        for archive in archives(self.path):
            with _opened(archive) as held:
                for info in sorted(held.infolist(), key=lambda i: i.filename):
                    if info.filename.endswith(".txt") and self.wanted in info.filename:
                        out += [Range(archive, info.filename, a, min(a + self.size, info.file_size)) for a in range(0, info.file_size, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Streams a range; what lies before it is unpacked and only counted."""
        with _opened(partition.archive) as held, held.open(partition.member) as f:
            at = number = 0
            while at < partition.start - 1:
                block = f.read(min(SKIP_BYTES, partition.start - 1 - at))
                at, number = at + len(block), number + block.count(b"\n")
            if partition.start:  # the line that crosses the border belongs to the range before
                crossing = f.readline()
                at, number = at + len(crossing), number + crossing.endswith(b"\n")
            lines: list[str] = []
            while at < partition.end and (line := f.readline()):
                at += len(line)
                lines.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                if len(lines) == BATCH_LINES:
                    yield self._batch(partition, number, lines)
                    number, lines = number + len(lines), []
            if lines:
                yield self._batch(partition, number, lines)

    def _batch(self, partition: Range, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.repeat(partition.archive, n), pa.repeat(partition.member, n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "line", "value"])


class ArchiveLines(DataSource):
    """``spark.read.format("archive_lines").option("member", part of a name).load(path)``; rangeBytes cuts long members."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def archive_lines(spark: SparkSession, path: str, member: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of the text members whose name holds ``member``: archive, member, line (from 0), value."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("member", member).option("rangeBytes", range_bytes).load(path)
