"""Ranks within groups of any size, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: str, spread: list[str], order: list[str], buckets: int, rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank``: 0 to n-1 within a group (a non-null column), in the order of a hash of ``spread``, then ``order``.

    The hash deals each group out to buckets; a bucket is sorted in one task, and starts at the count of the rows in the
    buckets before it. Rows that agree in all of ``order`` should be alike, as their ranks may swap when a task runs again.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col(group).alias("_group_s"), F.col("_bucket").alias("_bucket_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    both = dealt.withColumn("_within", within).join(starts, (F.col(group) == F.col("_group_s")) & (F.col("_bucket") == F.col("_bucket_s")))
    return both.select(*rows.columns, (F.col("_before") + F.col("_within") - 1).alias(rank))
