"""The shipped programs, each from inputs to a written output.

``single`` writes one part in sorted order, as the naive forms do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions.checks import within
from millrace.functions.keys import uuid
from millrace.functions.tokens import quoted_tsv
from millrace.operators.counting import word_count
from millrace.operators.lookup import lookup_join
from millrace.operators.nesting import nest
from millrace.operators.pairs import sample_pairs, sample_pairs_joined
from millrace.operators.sorting import sort_by_key
from millrace.sources.jsonl import json_lines
from millrace.sources.parquet import parquet_rows
from millrace.sources.text import text_lines, tsv_pairs

SEARCH = "query STRING, page_uuid STRING, position SMALLINT"
PAGE = "page_uuid STRING, body STRING"
_JOINED = ["query", "page_uuid", "position", "body"]


def wordcount_text(spark: SparkSession, path: str, out: str, strict_utf8: bool = False, single: bool = False) -> None:
    counts = word_count(text_lines(spark, path, strict_utf8), "value")
    lines = counts.select(quoted_tsv(F.col("word"), F.col("count")).alias("value"))
    sinks.write_text(lines.orderBy("value").coalesce(1) if single else lines, out, inputs=[path])


def wordcount_parquet(spark: SparkSession, path: str, out: str, column: str = "line", single: bool = False) -> None:
    counts = word_count(parquet_rows(spark, path, [column], glob="*.parquet"), column)
    sinks.write_parquet(counts.orderBy("word").coalesce(1) if single else counts, out, {"count": "int64", "word": "string"}, inputs=[path])


def joined(spark: SparkSession, searches: str | list[str], pages: str | list[str], lenient: bool = False) -> DataFrame:
    """Searches with the body of their page; of duplicate pages the least body holds."""
    left = within(json_lines(spark, searches, SEARCH, lenient=lenient), "position", 0, 255)
    right = json_lines(spark, pages, PAGE, lenient=lenient)
    key = {"page_uuid": uuid(F.col("page_uuid"))}
    return lookup_join(left.withColumns(key), right.withColumns(key), "page_uuid", "page_uuid", "body").select(*_JOINED)


def join(spark: SparkSession, searches: str, pages: str, out: str, single: bool = False) -> None:
    lines = joined(spark, searches, pages)
    lines = lines.select(sinks.json_line(lines, *_JOINED).alias("value"))
    sinks.write_text(lines.orderBy("value").coalesce(1) if single else lines, out, inputs=[searches, pages])


def join_nested(spark: SparkSession, searches: str, pages: str, out: str, single: bool = False, stage: str | None = None, keep: bool = False) -> None:
    """One plan. With ``stage``, the joined rows are written there as Parquet first, and go in the end unless ``keep``."""
    rows = joined(spark, searches, pages)
    if stage:
        sinks.write_parquet(rows, stage, inputs=[searches, pages])
        rows = parquet_rows(spark, stage).select(*_JOINED)
    nested = nest(rows, ["query"], ["page_uuid", "position", "body"], "docs")
    lines = nested.select(sinks.json_line(nested, "query", "docs").alias("value"))
    sinks.write_text(lines.orderBy("value").coalesce(1) if single else lines, out, inputs=[searches, pages, *([stage] if stage else [])])
    if stage and not keep:
        sinks.remove(spark, stage)


def ranking_pairs(spark: SparkSession, inputs: str | list[str], out: str, docs: str | None = None, body: str = "body_full", max_positive: int = 3, min_negative: int = 4, negatives: int = 4, seed: str = "0") -> None:
    """One stage where the main input holds the bodies, two where ``docs`` does."""
    inputs = [p for x in ([inputs] if isinstance(inputs, str) else inputs) for p in x.split(",")]
    main = parquet_rows(spark, inputs, merge=True)
    options = {"max_positive": max_positive, "min_negative": min_negative, "negatives": negatives, "seed": seed}
    if docs:
        made = sample_pairs_joined(main.drop(body), parquet_rows(spark, docs, ["page_uuid", body]), body=body, tie=["position", "page_uuid"], **options)
    else:
        made = sample_pairs(main, body=body, **options)
    sinks.write_json_lines(made, out, "neg_doc", "pos_doc", "query", inputs=[*inputs, *([docs] if docs else [])])


def sort_tsv(spark: SparkSession, path: str, out: str, single: bool = False) -> None:
    lines = sort_by_key(tsv_pairs(spark, path), "key", "line")
    sinks.write_text(lines.coalesce(1) if single else lines, out, line="line", inputs=[path])
