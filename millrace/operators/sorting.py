"""Sorts by key bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import length_first


def sort_by_key(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """All rows in bytewise order of the key: a range partitioning and a sort in each partition, which spills."""
    return df.orderBy(key, *ties)


def sort_parts(df: DataFrame, key: str, parts: int, shorter_first: bool = False) -> DataFrame:
    """Rows dealt out by key, each partition sorted: equal keys adjoin, no order between partitions.

    ``shorter_first``: the order of length-prefixed keys.
    """
    by = length_first(F.col(key)) if shorter_first else [F.col(key)]
    return df.repartition(parts, key).sortWithinPartitions(*by)


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
