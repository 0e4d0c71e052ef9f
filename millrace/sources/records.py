"""Length-prefixed binary records: ``[u32 length][payload]`` of flat structs.

A payload holds its fields in order: bigint and int as little-endian integers, double as 8 bytes, boolean as one byte,
string as a 64-bit length and UTF-8 bytes; a nullable field has one byte before it, 0 for null. A truncated tail and
records that don't decode are skipped. A file is read as one row, so it must fit a task's memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources import paths

_FIXED = {"bigint": struct.Struct("<q"), "int": struct.Struct("<i"), "double": struct.Struct("<d"), "boolean": struct.Struct("<?")}


def encode(values: tuple, kinds: list[str]) -> bytes:
    out = bytearray()
    for value, kind in zip(values, kinds, strict=True):
        out.append(value is not None)
        if value is None:
            continue
        if kind == "string":
            raw = value.encode()
            out += struct.pack("<Q", len(raw)) + raw
        else:
            out += _FIXED[kind].pack(value)
    return struct.pack("<I", len(out)) + bytes(out)


def _one(body: memoryview, kinds: list[str]) -> tuple:
    at, row = 0, []
    for kind in kinds:
        there, at = body[at], at + 1
        if not there:
            row.append(None)
        elif kind == "string":
            (n,) = struct.unpack_from("<Q", body, at)
            raw = bytes(body[at + 8 : at + 8 + n])
            if len(raw) != n:
                raise ValueError("short string")
            row.append(raw.decode())
            at += 8 + n
        else:
            row.append(_FIXED[kind].unpack_from(body, at)[0])
            at += _FIXED[kind].size
    return tuple(row)


def decode(content: bytes, kinds: list[str]) -> Iterator[tuple]:
    view, at = memoryview(content), 0
    while at + 4 <= len(view):
        (n,) = struct.unpack_from("<I", view, at)
        if at + 4 + n > len(view):
            return
        try:
            yield _one(view[at + 4 : at + 4 + n], kinds)
        except (ValueError, IndexError, struct.error):
            pass
        at += 4 + n


def _kinds(schema: T.StructType) -> list[str]:
    kinds = [f.dataType.simpleString() for f in schema]
    if bad := set(kinds) - {*_FIXED, "string"}:
        raise ValueError(f"records hold {', '.join([*_FIXED, 'string'])}, not {', '.join(sorted(bad))}")
    return kinds


def binary_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType, batch: int = 10_000) -> DataFrame:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds, arrow = _kinds(schema), to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for content in part.column(0):
                held: list[tuple] = []
                for row in decode(content.as_py(), kinds):
                    held.append(row)
                    if len(held) == batch:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths(path)).select("content")
    return files.mapInArrow(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def framed(df: DataFrame) -> DataFrame:
    """``value``: binary, one framed record a row of ``df``."""
    kinds = _kinds(df.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = [c.to_pylist() for c in part.columns]
            yield pa.RecordBatch.from_arrays([pa.array([encode(r, kinds) for r in zip(*columns, strict=True)], pa.binary())], names=["value"])

    return df.mapInArrow(rows, "value binary")
