"""Word counts and grouped sums. Partial aggregates combine before the shuffle, so a hot key costs a row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokens import tokens


def word_count(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """``count, [by...,] word``: how often each lower-cased token occurs in a string column, null texts aside.

    A column that is absent or no string counts as without texts.
    """
    by = by or []
    if text not in df.columns or df.schema[text].dataType.simpleString() != "string":
        df = df.limit(0).withColumn(text, F.lit(None).cast("string"))
    words = df.select(*by, F.explode(tokens(F.col(text))).alias("word"))
    return words.groupBy(*by, "word").agg(F.count("*").alias("count")).select("count", *by, "word")


def grouped(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """One row a key; without aggregates, the distinct keys."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]) if aggregates else df.select(*keys).distinct()
