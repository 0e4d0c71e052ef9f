"""Group rows under a key as an array of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(df: DataFrame, keys: list[str], fields: list[str], into: str) -> DataFrame:
    """``keys..., into``: the group's rows as structs of ``fields``, sorted by them so that the result is repeatable.

    A group is one row of the result, so it must fit a row (2 GB); that is the output that is asked for.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
