"""A data source for line files (plain or gzip): the reader keeps the lines that match and stops after so many of them.

spark.read.format("lines").option("path", glob).option("accept", regex).option("stop", n).load() gives file, line_no and
value.  Every file is a partition.  `stop` counts accepted lines, in every file; what comes after is not read, so an archive
need not be whole.  Equality on `file` is pushed down: other files are not opened.  Paths are those of Arrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

#: Lines in a batch.
BATCH = 4096


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _files(pattern: str) -> tuple[object, list[str]]:
    """The file system and the files that match; the last part of the path may have wildcards."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(pattern if "://" in pattern or pattern.startswith("file:") else f"file://{pattern}")
    folder, _, name = path.rpartition("/")
    if not any(c in name for c in "*?["):
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return system, [path]
        folder, name = path, "*"
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, name) and not f.base_name.startswith(("_", ".")))


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.accept = options["path"], options.get("accept", "")
        self.stop = int(options["stop"]) if "stop" in options else None
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.pattern)[1] if self.only in (None, p.rpartition("/")[2])] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        system, _ = _files(self.pattern)
        name, wanted = partition.value.rpartition("/")[2], re.compile(self.accept)
        rows: list[tuple[int, str]] = []
        taken = 0
        compression = "gzip" if name.endswith(".gz") else None
        with system.open_input_stream(partition.value, compression=compression, buffer_size=1 << 16) as stream:
            for number, line in enumerate(_lines(stream)):
                if self.stop is not None and taken >= self.stop:
                    break
                if wanted.search(line):
                    rows.append((number, line))
                    taken += 1
                    if len(rows) == BATCH or taken == self.stop:
                        yield _batch(name, rows)
                        rows = []
                        if taken == self.stop:
                            break
        if rows:
            yield _batch(name, rows)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(1 << 16):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (x.decode("utf-8", "replace").removesuffix("\r") for x in whole)
    if rest:
        yield rest.decode("utf-8", "replace")


def _batch(name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([v for _, v in rows])], names=["file", "line_no", "value"])


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "file string, line_no long, value string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Lines)
