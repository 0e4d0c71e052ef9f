"""Assertions inside plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(df: DataFrame, *names: str) -> DataFrame:
    """Fail the job on a null in any of the named columns."""
    def check(name: str) -> Column:
        return F.when(df[name].isNull(), F.raise_error(F.lit(f"required column {name} is null"))).otherwise(df[name])

    return df.withColumns({n: check(n).cast(df.schema[n].dataType) for n in names})


def within(df: DataFrame, name: str, least: int, most: int) -> DataFrame:
    """Fail the job on a value outside ``least``..``most``; nulls pass."""
    bad = F.raise_error(F.concat(F.lit(f"{name} out of range: "), df[name].cast("string")))
    return df.withColumn(name, F.when(df[name].isNull() | df[name].between(least, most), df[name]).otherwise(bad).cast(df.schema[name].dataType))


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > 0)


def int32(c: Column) -> Column:
    """A bigint as int; a value that doesn't fit fails the job."""
    bad = F.raise_error(F.concat(F.lit("out of the range of int: "), c.cast("string")))
    return F.when(c.between(-(2**31), 2**31 - 1), c).otherwise(F.when(c.isNull(), F.lit(None)).otherwise(bad)).cast("int")
