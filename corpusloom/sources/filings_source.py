"""Filings as a data source of Spark: the HTML files of a folder, as a table or as a stream.

``spark.read.format("filings").load(folder)`` and ``spark.readStream.format("filings")...`` give
(source_file, modified, length, html). Conditions on the file's name are met when the folder is
listed, before any file is opened; partitions are runs of files of about ``partition_bytes``. A
stream's offset is the time and name of the last file it has come to, in that order, so that a
file is seen once, and once more when it is changed. A file whose time lies before the offset when
it appears is not new; ``from_start`` is what a fresh checkpoint gives.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..operators.filings import decode_bytes

SCHEMA = "source_file string, modified timestamp, length long, html string"
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Found:
    """A file: its time in nanoseconds and its name, which order the stream, its place and size."""

    time: int
    name: str
    path: str
    size: int


@dataclass
class Files(InputPartition):
    files: tuple[Found, ...]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def listed(folder: str, pattern: str) -> list[Found]:
    """Files of the folder itself whose name fits, by time and name."""
    from pyarrow import fs

    system, root = _filesystem(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and fnmatch.fnmatchcase(f.base_name, pattern) and not f.base_name.startswith((".", "_"))]
    return sorted((Found(f.mtime_ns or 0, f.base_name, f.path, f.size) for f in found), key=lambda f: (f.time, f.name))


def runs(files: list[Found], most: int) -> list[Files]:
    out: list[list[Found]] = []
    size = most
    for f in files:
        if size + f.size > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [Files(tuple(x)) for x in out]


class _Reads:
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.html")
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import datetime, timezone

        system, _ = _filesystem(self.folder)
        for f in partition.files:
            with system.open_input_stream(f.path, compression=None) as stream:
                yield f.name, datetime.fromtimestamp(f.time / 1e9, timezone.utc), f.size, decode_bytes(stream.read())


class FilingReader(_Reads, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            test = None
            if getattr(f, "attribute", None) == ("source_file",):
                value = getattr(f, "value", None)
                if isinstance(f, EqualTo):
                    test = lambda name, v=value: name == v
                elif isinstance(f, In):
                    test = lambda name, v=value: name in v
                elif isinstance(f, StringStartsWith):
                    test = lambda name, v=value: name.startswith(v)
                elif isinstance(f, StringEndsWith):
                    test = lambda name, v=value: name.endswith(v)
                elif isinstance(f, StringContains):
                    test = lambda name, v=value: v in name
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        return runs([f for f in listed(self.folder, self.pattern) if all(t(f.name) for t in self.tests)], self.bytes)


class FilingStream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        found = listed(self.folder, self.pattern)
        return {"time": found[-1].time, "name": found[-1].name} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["time"], x["name"]) for x in (start, end))
        return runs([f for f in listed(self.folder, self.pattern) if low < (f.time, f.name) <= high], self.bytes)


class FilingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FilingReader:
        return FilingReader(dict(self.options))

    def streamReader(self, schema: StructType) -> FilingStream:
        return FilingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
