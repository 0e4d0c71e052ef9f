import pytest
from pyspark.sql import functions as F

from millrace.functions.checks import non_empty, required, within
from millrace.functions.keys import length_first, partition_number, uuid
from millrace.functions.tokens import quoted_tsv, tokens
from millrace.session import truthy


def test_tokens_are_ascii_runs(spark):
    rows = spark.createDataFrame([("Don't_2 café NAÏVE x-y",), (None,), ("",)], "t string").select(tokens("t").alias("w")).collect()
    assert [r["w"] for r in rows] == [["don't_2", "caf", "na", "ve", "x", "y"], None, []]


def test_uuid_forms(spark):
    plain = "0123456789ABCDEF0123456789abcdef"
    forms = [plain, "01234567-89ab-cdef-0123-456789abcdef", "{01234567-89AB-cdef-0123-456789abcdef}", "urn:uuid:01234567-89ab-cdef-0123-456789abcdef", None]
    df = spark.createDataFrame([(f,) for f in forms], "u string")
    assert [r[0] for r in df.select(uuid(F.col("u"))).collect()] == ["01234567-89ab-cdef-0123-456789abcdef"] * 4 + [None]
    with pytest.raises(Exception, match="not a UUID"):
        spark.createDataFrame([("xyz",)], "u string").select(uuid(F.col("u"))).collect()


def test_checks_fail_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (256, "")], "n int, s string")
    with pytest.raises(Exception, match="required column n"):
        required(df, "n").collect()
    with pytest.raises(Exception, match="out of range"):
        within(df, "n", 0, 255).collect()
    assert within(df.where("n is null or n < 9"), "n", 0, 255).count() == 2
    assert [r["s"] for r in df.where(non_empty(F.col("s"))).collect()] == ["a", "b"]


def test_order_and_partitions(spark):
    df = spark.createDataFrame([(x,) for x in ["bb", "c", "a", "ab"]], "k string")
    assert [r[0] for r in df.coalesce(1).sortWithinPartitions(*length_first(F.col("k"))).collect()] == ["a", "c", "ab", "bb"]
    assert all(0 <= r[0] < 7 for r in df.select(partition_number(F.col("k"), 7)).collect())
    assert df.limit(1).select(quoted_tsv(F.lit("x"), F.lit(3))).first()[0] == '"x"\t3'
    assert [truthy(x) for x in ("1", "TRUE", "Yes", "on", "0", "", None)] == [True] * 4 + [False] * 3
