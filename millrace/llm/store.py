"""Tables written in the folder that the cluster shares, and small numeric helpers."""

from __future__ import annotations

import os
import uuid
from types import TracebackType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir, truthy

#: Set to a true value, tables that are no longer read are kept, to look into a job.
_KEEP = "MILLRACE_KEEP_TABLES"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _keep() -> bool:
    return truthy(os.environ.get(_KEEP))


def _written(df: DataFrame, name: str, compression: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _keep():
        fs, at = _file_system(spark, path)
        fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it, which cuts the lineage.

    The table outlives any executor, so what is read later never depends on blocks of a lost one. It goes when the driver ends.
    """
    return _written(df, name, compression)[0]


class Tables:
    """Tables like those of ``materialise`` that go as soon as they are dropped, and with the ``with`` block at the latest."""

    def __init__(self, spark: SparkSession):
        self._spark, self._held = spark, []

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        table, path = _written(df, name, compression)
        self._held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the tables, and have the driver forget the plans that led to them: only then go their shuffle files."""
        for table, path in [(t, p) for t, p in self._held if any(t is x for x in tables)]:
            if not _keep():
                fs, at = _file_system(self._spark, path)
                fs.delete(at, True)
            self._held = [(t, p) for t, p in self._held if t is not table]
        self._spark.sparkContext._jvm.System.gc()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.drop(*[t for t, _ in self._held])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver. They go by Arrow: a list of tuples takes Python workers of another kind, which then stay."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
