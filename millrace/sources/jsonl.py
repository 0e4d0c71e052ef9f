"""JSON Lines with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.checks import required
from millrace.sources import paths


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType, need: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """Rows of a JSON Lines input. ``need``: fields without which a line is bad (all of them where None).

    Strict: a malformed line, a value of the wrong type, or a missing needed field fails the job. Lenient: such lines are
    skipped. Fields that the schema doesn't name are ignored.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    need = schema.fieldNames() if need is None else need
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED" if lenient else "FAILFAST")
    rows = reader.json(paths(path))
    return rows.na.drop(how="any", subset=need) if lenient and need else required(rows, *need)
