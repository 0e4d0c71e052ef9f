"""Joins whose hot keys can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(rows: DataFrame, of_groups: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``of_groups``, an aggregate by ``key`` (columns without nulls). The join goes by a hash of the key
    made after the grouping, so that both sides are dealt out anew and the rows of a hot group can be split."""
    right = of_groups.select(F.xxhash64(*key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in key], *[c for c in of_groups.columns if c not in key])
    on = [F.col("_h") == F.col("_k"), *[F.col(c) == F.col(f"_{c}") for c in key]]
    return rows.withColumn("_h", F.xxhash64(*key)).join(right, on, how).drop("_h", "_k", *[f"_{c}" for c in key])
