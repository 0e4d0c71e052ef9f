import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.checks import int32
from millrace.metrics import counted, phases, splits
from millrace.operators.counting import grouped, word_count
from millrace.operators.lookup import lookup_join
from millrace.operators.mapreduce import Pipeline, reduce_groups
from millrace.operators.nesting import nest
from millrace.operators.pairs import sample_pairs, sample_pairs_joined
from millrace.operators.sorting import first_per_group, sort_by_key, sort_parts
from millrace.session import shared_dir


def test_word_count_without_the_column(spark):
    df = spark.createDataFrame([(1, "a A b"), (2, None)], "n int, line string")
    assert {(r["word"], r["count"]) for r in word_count(df, "line").collect()} == {("a", 2), ("b", 1)}
    assert word_count(df, "n").count() == word_count(df, "gone").count() == 0
    assert {tuple(r) for r in grouped(df, ["n"]).collect()} == {(1,), (2,)}


def test_lookup_never_multiplies(spark):
    left = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), (None, 4), ("k9", 5)], "key string, n int")
    right = spark.createDataFrame([("k1", "b", 2), ("k1", "a", 3), ("k1", "", 1), ("k2", None, 1), (None, "z", 1), ("k3", "q", 1)], "key string, body string, ord int")
    of = lambda **o: sorted((r["n"], r["body"]) for r in lookup_join(left, right, "key", "key", "body", **o).collect())
    assert of(policy="max") == [(1, "b"), (2, "b"), (3, None)]
    assert of(policy="first", order=["ord"]) == [(1, ""), (2, ""), (3, None)]
    assert of(policy="last", order=["ord"]) == [(1, "a"), (2, "a"), (3, None)]
    assert of(policy="first", order=["ord"], skip_empty=True) == [(1, "b"), (2, "b")]


def test_nest_is_sorted(spark):
    df = spark.createDataFrame([("q", 2, "b"), ("q", 1, "z"), ("r", 1, "a")], "query string, position int, body string")
    rows = {r["query"]: [tuple(d) for d in r["docs"]] for r in nest(df, ["query"], ["position", "body"], "docs").collect()}
    assert rows == {"q": [(1, "z"), (2, "b")], "r": [(1, "a")]}


ROWS = "qid string, q string, country string, position int, page_uuid string, body_full string"


def test_sampling_keeps_its_invariants(spark):
    random.seed(1)
    rows = [(f"g{random.randrange(30)}", "query", "us", random.randrange(1, 9), f"p{i}", f"body {i}") for i in range(600)]
    df = spark.createDataFrame(rows, ROWS)
    got = sample_pairs(df, group="qid").collect()
    again = sample_pairs(df.repartition(7), group="qid").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, sample_pairs(df, group="qid", seed="other").collect()))
    where = {b: (g, p) for g, _, _, p, _, b in rows}
    for r in got:
        group, position = where[r["pos_doc"]]
        assert position <= 3 and len(set(r["neg_doc"])) == len(r["neg_doc"]) <= 4 and r["query"] == "query\nus"
        assert all(where[n][0] == group and where[n][1] >= 4 for n in r["neg_doc"])
    assert len(got) == len({g for g, _, _, p, _, _ in rows if p <= 3})


def test_sampling_edges(spark):
    rows = [
        ("only_pos", "q", "us", 1, "p1", "b1"), ("only_neg", "q", "us", 5, "p2", "b2"), ("empty", "q", "", 1, "p3", ""), ("null_country", "q", None, 1, "p4", "b4"),
        ("null_body", "q", "us", 1, "p5", None), ("overlap", "q", "us", 4, "p6", "b6"), ("gap", "q", "us", 4, "p7", "b7"),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["pos_doc"]: r for r in sample_pairs(df).collect()}
    assert set(got) == {"b1", ""} and got["b1"]["neg_doc"] == [] and got[""]["query"] == "q\n"
    assert {r["pos_doc"] for r in sample_pairs(df, max_positive=4, min_negative=3).collect()} == {"b1", "", "b6", "b7"}
    docs = spark.createDataFrame([("p1", None), ("p1", ""), ("p1", "found"), ("p3", "x"), ("p4", "y")], "page_uuid string, body_full string")
    assert [r["pos_doc"] for r in sample_pairs_joined(df.drop("body_full"), docs, tie=["position", "page_uuid"]).collect()] == ["found"]


def test_sorts(spark):
    df = spark.createDataFrame([(x,) for x in ["é", "Z", "a", "ab", "z", ""]], "k string")
    assert [r[0] for r in sort_by_key(df, "k").collect()] == ["", "Z", "a", "ab", "z", "é"]
    parts = sort_parts(df, "k", 3).rdd.glom().collect()
    assert all([r[0] for r in p] == sorted([r[0] for r in p], key=lambda s: s.encode()) for p in parts)
    top = first_per_group(df.withColumn("g", F.lit(1)), ["g"], [F.col("k")], 2).collect()
    assert sorted(r["k"] for r in top) == ["", "Z"]


def _twice(rows):
    for r in rows:
        for _ in range(r["n"]):
            yield r["k"], r["n"]


def _sums(key, rows):
    total = sum(r["n"] for r in rows)
    if total > 1:
        yield key[0], total
        yield key[0], -total


def test_map_reduce(spark):
    a, b = spark.createDataFrame([("x", 2), ("y", 0)], "k string, n long"), spark.createDataFrame([("x", 1)], "k string, m long")
    pipe = Pipeline().input(a, tag="a").input(b, lambda df: df.withColumnRenamed("m", "n"), tag="b").map(_twice, "k string, n long")
    out = pipe.reduce(["k"], reducer=_sums, schema="k string, total long").frame
    assert {tuple(r) for r in out.collect()} == {("x", 5), ("x", -5)}
    plain = Pipeline().input(a).map(lambda df: df.where("n > 0")).reduce(["k"], F.sum("n").alias("s")).frame
    assert [tuple(r) for r in plain.collect()] == [("x", 2)]
    assert reduce_groups(a.limit(0), ["k"], _sums, "k string, total long").count() == 0


def test_counted(spark):
    df, seen = counted(spark.range(7), "rows seen")
    df.collect()
    assert json.dumps(seen.get) == '{"rows": 7}'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_lookup_key_can_be_split(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
        left = spark.range(0, 200_000, 1, 8).selectExpr("if(id % 10 < 9, 7, id) as key", "id as n", "uuid() as pad")
        right = spark.range(0, 300_000, 1, 8).selectExpr("id % 150000 as key", "id as body")
        joined = lookup_join(left, right, "key", "key", "body")
        assert joined.count() == 20_000 * 8 + 20_000 * 2 - sum(1 for i in range(9, 200_000, 10) if i >= 150_000)
        assert "skew=true" in _run_plan(joined)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _run_plan(df):
    """The plan as adaptive execution left it."""
    df.collect()
    return plan_of(df)


def test_sampling_cuts_groups_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame([("g", "q", "us", 1, "p", "b")], ROWS).write.parquet(str(tmp_path / "rows"))
    plan = plan_of(sample_pairs(spark.read.parquet(str(tmp_path / "rows"))))
    assert plan.count("WindowGroupLimit") == 2


def test_key_types_may_differ(spark):
    left, right = spark.createDataFrame([(5, "x")], "key int, a string"), spark.createDataFrame([(5, "y")], "key bigint, body string")
    assert [r["body"] for r in lookup_join(left, right, "key", "key", "body").collect()] == ["y"]


def test_int32(spark):
    df = spark.createDataFrame([(-(2**31),), (2**31 - 1,), (None,)], "n bigint")
    assert [r[0] for r in df.select(int32(F.col("n"))).collect()] == [-(2**31), 2**31 - 1, None]
    with pytest.raises(Exception, match="out of the range of int"):
        spark.createDataFrame([(2**31,)], "n bigint").select(int32(F.col("n"))).collect()


def test_phases_count_what_ran(spark, tmp_path):
    ran = []
    with phases(spark, ran):
        spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "out"))
    assert sum(s["rows_out"] for s in ran) == 7 and sum(s["shuffle_rows_written"] for s in ran) == 21 == sum(s["shuffle_rows_read"] for s in ran)
    assert len(splits(spark, str(tmp_path / "out"))) >= 1 and splits(spark, str(tmp_path / "out"), 1)[0].endswith(".parquet")


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = Conf

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
