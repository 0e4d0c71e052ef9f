"""Parquet with projection and normalised types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import paths


def parquet_rows(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, merge: bool = False, glob: str | None = None) -> DataFrame:
    """Rows of a Parquet input. ``columns``: the ones to read (none or empty: all; absent names are ignored); the scan
    then reads no other. ``merge``: unite the schemas of all files. ``glob``: such as ``*.parquet``.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", merge)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(*paths(path))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def normalised(df: DataFrame) -> DataFrame:
    """All integers to bigint (unsigned 64-bit ones wrap), float to double; other types stay, nested ones too."""
    half, whole = F.lit(str(2**63 - 1)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(21,0)")

    def one(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0):
            c = F.when(c > half, c.cast("decimal(21,0)") - whole).otherwise(c.cast("decimal(21,0)")).cast("bigint")
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(kind, T.FloatType):
            c = c.cast("double")
        return c.alias(field.name)

    return df.select(*[one(f) for f in df.schema])
