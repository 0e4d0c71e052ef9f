"""Text lines and key-tab-value lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import paths


def text_lines(spark: SparkSession, path: str | list[str], strict_utf8: bool = False) -> DataFrame:
    """``value``: one row a line. Lines end at a line feed; one carriage return before it goes, others are data; blank
    lines stay.

    The plain reader splits large files and turns invalid bytes to U+FFFD. ``strict_utf8`` reads a file as one row and gives
    no line at all of a file that isn't valid UTF-8; such a file must fit a task's memory and be under 2 GB.
    """
    if strict_utf8:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths(path))
        text = F.try_validate_utf8(F.col("content").cast("string"))
        body = whole.select(F.regexp_replace(text, r"\n\z", "").alias("t"), (F.length("content") > 0).alias("some")).where("t is not null and some")
        lines = body.select(F.explode(F.split("t", "\n", -1)).alias("value"))
    else:
        lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths(path))
    return lines.select(F.regexp_replace("value", r"\r\z", "").alias("value"))


def tsv_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``key, value, line``: the key ends at the first tab, or is the whole line (value null then); blank lines go."""
    lines = text_lines(spark, path).where(F.length("value") > 0)
    at = F.instr("value", "\t")
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    return lines.select(F.substring_index("value", "\t", 1).alias("key"), rest.alias("value"), F.col("value").alias("line"))
