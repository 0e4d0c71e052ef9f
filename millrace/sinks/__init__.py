"""Writers: text lines, JSON Lines, Parquet and binary records, each through Spark's commit protocol."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import paths
from millrace.sources.records import framed

#: Types that the row sink takes, by the name a schema gives them.
SINK_TYPES = {"bool": "boolean", "int64": "bigint", "double": "double", "string": "string", "bytes": "binary", "timestamp_micros": "timestamp"}


def input_roots(df: DataFrame) -> list[str]:
    """The paths that the files of a plan were asked for by; no folder is listed for it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for leaf in (leaves.apply(i) for i in range(leaves.length())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(i).toString() for i in range(roots.length())]
    return found


def _writer(df: DataFrame, path: str, inputs: list[str]) -> tuple[DataFrameWriter, str]:
    """Overwrites the output folder, but never one that the job reads."""
    (out,) = paths(path)
    clean = lambda p: re.sub("^file:/+", "/", p).rstrip("/") + "/"
    if hit := [p for p in [*paths(inputs), *input_roots(df)] if clean(p).startswith(clean(out))]:
        raise ValueError(f"the output {out} holds an input: {hit[0]}")
    return df.write.mode("overwrite"), out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Hadoop knows."""
    (at,) = paths(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_text(df: DataFrame, path: str, line: str = "value", inputs: list[str] = ()) -> None:  # type: ignore[assignment]
    """One line a row of the string column ``line``."""
    writer, out = _writer(df.select(F.col(line).alias("value")), path, list(inputs))
    writer.text(out, lineSep="\n")


def json_line(df: DataFrame, *names: str) -> Column:
    """A compact JSON object of the named columns, in that order, nulls included."""
    return F.to_json(F.struct(*(names or df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, *names: str, inputs: list[str] = ()) -> None:  # type: ignore[assignment]
    write_text(df.select(json_line(df, *names).alias("value")), path, inputs=list(inputs))


def sink_rows(df: DataFrame, schema: dict[str, str], plain_micros: bool = False) -> DataFrame:
    """``df`` as the row sink has it: columns in alphabetical order, those absent as nulls, those unnamed left out.

    Integers may become doubles, and integers (microseconds) and timestamps each other; other mismatches raise an error.
    ``plain_micros`` writes timestamps as integers.
    """

    def one(name: str) -> Column:
        want = SINK_TYPES[schema[name]]
        if name not in df.columns:
            return F.lit(None).cast("bigint" if plain_micros and want == "timestamp" else want).alias(name)
        c, have = F.col(f"`{name}`"), df.schema[name].dataType
        whole, timed = isinstance(have, T.IntegralType), isinstance(have, T.TimestampType | T.TimestampNTZType)
        if want == "bigint" and timed or want == "timestamp" and timed and plain_micros:
            return F.unix_micros(c.cast("timestamp")).alias(name)
        if want == "timestamp" and whole:
            return (c.cast("bigint") if plain_micros else F.timestamp_micros(c.cast("bigint"))).alias(name)
        if have.simpleString() == want or whole and want in ("bigint", "double") or isinstance(have, T.FloatType) and want == "double" or timed and want == "timestamp":
            return c.cast(want).alias(name)
        raise TypeError(f"column {name} is {have.simpleString()}, the sink wants {want}")

    return df.select(*[one(n) for n in sorted(schema)])


def write_parquet(df: DataFrame, path: str, schema: dict[str, str] | None = None, plain_micros: bool = False, inputs: list[str] = ()) -> None:  # type: ignore[assignment]
    """Snappy Parquet; with ``schema``, as ``sink_rows``; else the columns alone are put in alphabetical order."""
    rows = sink_rows(df, schema, plain_micros) if schema else df.select(*sorted(df.columns))
    writer, out = _writer(rows, path, list(inputs))
    writer.option("compression", "snappy").parquet(out)


def write_records(df: DataFrame, path: str, inputs: list[str] = ()) -> None:  # type: ignore[assignment]
    """Length-prefixed binary records, one ``.bin`` file a task, by the Python data source below."""
    from millrace.sinks.binary import BinaryFiles

    df.sparkSession.dataSource.register(BinaryFiles)
    _, out = _writer(df, path, list(inputs))
    framed(df).write.format(BinaryFiles.name()).mode("overwrite").save(out)
