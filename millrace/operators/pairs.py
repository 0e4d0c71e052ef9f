"""Ranking training pairs: for each query one positive document and up to N negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup_join


def sample_pairs(
    rows: DataFrame, group: str = "qid", query: str = "q", country: str = "country", position: str = "position", body: str = "body_full", tie: list[str] | None = None,
    max_positive: int = 3, min_negative: int = 4, negatives: int = 4, seed: str = "0", drop_empty_country: bool = False,
) -> DataFrame:
    """``neg_doc, pos_doc, query``: one row a group that has a positive.

    Rows up to ``max_positive`` are positives; of the rest, those from ``min_negative`` are negatives. The choice is by the
    md5 of the seed and the ``tie`` columns, so it is repeatable whatever the partitions. Query and country are those of
    the group's least row by ``tie``, whatever its position. Rows without country or body don't count; empty ones do, but
    for empty countries under ``drop_empty_country``. Tasks cut what they have of a group to N rows a side before the
    shuffle.
    """
    tie = tie or [position, body]
    rows = rows.where(F.col(country).isNotNull() & F.col(body).isNotNull())
    if drop_empty_country:
        rows = rows.where(F.length(country) > 0)
    side = F.when(F.col(position) <= max_positive, F.lit("p")).when(F.col(position) >= min_negative, F.lit("n"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(t).cast("string") for t in tie]).cast("binary"))
    keyed = rows.select(F.col(group).alias("g"), side.alias("side"), draw.alias("draw"), F.col(body).alias("body"))
    rank = F.row_number().over(Window.partitionBy("g", "side").orderBy("draw", "body"))
    # The first bound is a plain number, which Spark takes into the tasks before the shuffle.
    chosen = keyed.where("side is not null").withColumn("rank", rank).where(F.col("rank") <= max(1, negatives)).where(F.col("rank") <= F.when(F.col("side") == "p", 1).otherwise(negatives))
    picked = chosen.groupBy("g").agg(
        F.max(F.when(F.col("side") == "p", F.col("body"))).alias("pos_doc"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == "n", F.struct("rank", "body")))), lambda x: x["body"]).alias("neg_doc"),
    )
    # A second read of ``rows``: an aggregate that combines before the shuffle is cheaper than sorting every row twice.
    meta = rows.groupBy(F.col(group).alias("g_m")).agg(F.min_by(F.struct(F.col(query).alias("q"), F.col(country).alias("c")), F.struct(*tie)).alias("m"))
    joined = picked.where("pos_doc is not null").join(meta, F.col("g") == F.col("g_m"))
    return joined.select("neg_doc", "pos_doc", F.concat("m.q", F.lit("\n"), "m.c").alias("query"))


def sample_pairs_joined(rows: DataFrame, docs: DataFrame, key: str = "page_uuid", body: str = "body_full", country: str = "country", **options) -> DataFrame:
    """The two-stage form: bodies are looked up (the first non-empty one of a key), a missing country counts as empty,
    and rows with an empty country go. One plan; nothing is written between the stages."""
    main = rows.withColumn(country, F.coalesce(country, F.lit("")))
    full = lookup_join(main, docs, key, key, body, skip_empty=True)
    return sample_pairs(full, body=body, country=country, drop_empty_country=True, **options)
