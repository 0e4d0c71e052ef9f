"""Formats, sources and sinks of one's own, on Spark's Python data source API.

A format turns the bytes of a split into records; a source lists the splits under a name and opens them; a sink opens a part
and writes records to it. Any of them may be given; what isn't is the default: a source of files through pyarrow's file
systems, and the registered formats. Functions are sent to the workers, so they must be picklable by cloudpickle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of a split in, records (tuples in the order of the schema) out.
Format = Callable[[bytes], Iterable[tuple]]
#: A name in, its splits out; a split in, its bytes out.
Lister = Callable[[str], list[str]]
Opener = Callable[[str], bytes]
#: Folder and part number in; a writer of records out, which is called once a record and then with None.
PartWriter = Callable[[str, int], Callable[[tuple | None], None]]

FORMATS: dict[str, tuple[Format, str]] = {}
SOURCES: dict[str, tuple[Lister, Opener]] = {}


def register_format(name: str, decode: Format, schema: str) -> None:
    """``schema``: DDL of the records."""
    FORMATS[name] = decode, schema


def register_source(scheme: str, list_splits: Lister, open_split: Opener) -> None:
    """For names that start with ``scheme://``."""
    SOURCES[scheme] = list_splits, open_split


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """All files under a path, in the order of their paths; hidden ones and those with ``_`` first are left out."""
    files, top = _files(path)
    at = files.get_file_info(top)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted(scheme + f.path for f in found)


def open_file(path: str) -> bytes:
    files, at = _files(path)
    with files.open_input_stream(at) as stream:
        return stream.read()


@dataclass
class _Split(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, splits: list[str], opener: Opener, decode: Format):
        self.splits, self.opener, self.decode = splits, opener, decode

    def partitions(self) -> list[InputPartition]:
        return [_Split(s) for s in self.splits]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.decode(self.opener(partition.name))


def read(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """Rows of all splits under ``uri``, one task a split, in the registered format ``name``."""
    decode, ddl = FORMATS[name]
    scheme = uri.split("://", 1)[0] if "://" in uri else ""
    lister, opener = SOURCES.get(scheme, (list_files, open_file))
    # An empty input still needs a partition.
    splits = lister(uri)
    if not splits:
        return spark.createDataFrame([], ddl)

    class Plugged(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"millrace_{name}"

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(splits, opener, decode)

    spark.dataSource.register(Plugged)
    return spark.read.format(f"millrace_{name}").load()


@dataclass
class _Part(WriterCommitMessage):
    number: int
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, open_part: PartWriter):
        self.folder, self.open_part = folder, open_part

    def write(self, iterator: Iterator[Row]) -> _Part:
        from pyspark import TaskContext

        number, rows = TaskContext.get().partitionId(), 0
        put = self.open_part(self.folder, number)
        for row in iterator:
            put(tuple(row))
            rows += 1
        put(None)
        return _Part(number, rows)


def write(df: DataFrame, folder: str, name: str, open_part: PartWriter) -> None:
    """Every partition through a part writer of one's own. A part may be written twice where a task is tried again, so a writer
    should replace what stands under its number."""
    fields = df.schema

    class Plugged(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"millrace_out_{name}"

        def schema(self) -> StructType:
            return fields

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(folder, open_part)

    df.sparkSession.dataSource.register(Plugged)
    df.write.format(f"millrace_out_{name}").mode("append").save()


def record_rows(spark: SparkSession, records: Iterable[Any], to_row: Callable[[Any], dict], schema: str) -> DataFrame:
    """Records held by the driver as rows, by an adapter that makes a dict of each; fields it leaves out are null."""
    names = StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in map(to_row, records)], schema)
