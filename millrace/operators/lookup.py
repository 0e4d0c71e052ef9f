"""Lookup joins: every left row meets at most one right row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(right: DataFrame, key: str, value: str, policy: str = "min", order: list[str] | None = None, skip_empty: bool = False) -> DataFrame:
    """``key, value``: one value a key. ``policy``: min or max of the values, or the first or last by ``order``.

    Null keys and, under ``skip_empty``, null and empty values go first. It aggregates before the shuffle.
    """
    rows = right.where(F.col(key).isNotNull())
    if skip_empty:
        rows = rows.where(F.col(value).isNotNull() & (F.length(value) > 0))
    if policy in ("first", "last"):
        if not order:
            raise ValueError(f"{policy} needs an order")
        by = F.struct(*order, value)
        pick: Column = F.min_by(F.col(value), by) if policy == "first" else F.max_by(F.col(value), by)
    else:
        pick = {"min": F.min, "max": F.max}[policy](value)
    return rows.groupBy(key).agg(pick.alias(value))


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, unique: bool = False, **dedupe) -> DataFrame:
    """``left`` with ``value`` of the right side; rows without a partner on either side go, and duplicate right keys don't
    multiply rows. ``unique`` promises that right keys are unique, which saves the grouping.

    Catalyst broadcasts the right side where its size is under the threshold. Else both sides are shuffled: the right one is
    joined by a hash of the key that is made after the grouping, so it is dealt out anew like the left one, and AQE can split
    a left key that many rows have.
    """
    side = right.select(right_key, value) if unique else one_per_key(right, right_key, value, **dedupe)
    side = side.select(F.col(right_key).alias("_lookup_key"), F.col(value).alias("_lookup_value"))
    on, rows = left[left_key] == side["_lookup_key"], left
    if not unique and left.schema[left_key].dataType == side.schema["_lookup_key"].dataType:
        rows, side = left.withColumn("_lookup_hash", F.xxhash64(left_key)), side.withColumn("_lookup_of", F.xxhash64("_lookup_key"))
        on = (F.col("_lookup_hash") == F.col("_lookup_of")) & (F.col(left_key) == F.col("_lookup_key"))
    joined = rows.join(side, on, "inner").drop("_lookup_key", "_lookup_hash", "_lookup_of")
    return (joined.drop(value) if value in left.columns else joined).withColumnRenamed("_lookup_value", value)
