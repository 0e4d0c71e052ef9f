"""Connected components of an edge table that may be larger than any machine, with hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import Tables


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the least of u and u's neighbours. The join key is a hash made after the grouping, so that
    both sides are dealt out anew and a hub's edges can be split."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.xxhash64("u").alias("k"), F.col("u").alias("u_m"), "m")
    keyed = edges.withColumn("k_e", F.xxhash64("u"))
    return keyed.join(least, (F.col("k_e") == F.col("k")) & (F.col("u") == F.col("u_m"))).select("u", "v", "m")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and roots have none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str, tables: Tables) -> DataFrame:
    """id, component: each node that has an edge, with the least node it is connected to. One of ``tables``.

    Large stars and small stars by turns until only stars are left; each turn is written to the shared folder and replaces
    the one before, and only a yes or no reaches the driver.
    """
    now = tables.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _with_least(large)
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = tables.write(small, "stars")
        tables.drop(now)
        now = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    done = tables.write(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots), "components")
    tables.drop(now)
    return done
