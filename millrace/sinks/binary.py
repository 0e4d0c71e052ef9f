"""A Spark Python data source that writes binary values as files.

Every task writes a file of its own through pyarrow's file systems, so a path must be one that all executors share (a
mounted folder, or a store that pyarrow opens). Files are named by the attempt and only those of the attempts that Spark
commits are given their final names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class _Written(WriterCommitMessage):
    part: int
    held: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://") if path.startswith("file://") else path, overwrite

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        from pyspark import TaskContext

        files, top = self._open()
        part = TaskContext.get().partitionId()
        held, rows = f"{top}/.writing/{uuid.uuid4().hex}", 0
        files.create_dir(f"{top}/.writing", recursive=True)
        with files.open_output_stream(held) as out:
            for row in iterator:
                out.write(bytes(row[0]))
                rows += 1
        return _Written(part, held if rows else None)

    def commit(self, messages: list[_Written]) -> None:
        files, top = self._open()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    files.delete_file(old.path)
        for m in messages:
            if m and m.held:
                files.move(m.held, f"{top}/part-{m.part:05d}.bin")
        files.create_dir(f"{top}/.writing", recursive=True)
        files.delete_dir(f"{top}/.writing")

    def abort(self, messages: list[_Written]) -> None:
        files, top = self._open()
        if files.get_file_info(f"{top}/.writing").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/.writing")


class BinaryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_binary"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
