import datetime
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace import sinks
from millrace.sources.jsonl import json_lines
from millrace.sources.parquet import normalised, parquet_rows
from millrace.sources.records import binary_records, decode, encode
from millrace.sources.text import text_lines, tsv_pairs


def test_text_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one\r\n\nlone\rcr\nlast")
    (tmp_path / "sub" / "b.txt").write_bytes(b"nested\n")
    (tmp_path / "_hidden.txt").write_bytes(b"hidden\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    want = sorted(["one", "", "lone\rcr", "last", "nested"])
    for strict in (False, True):
        assert sorted(r[0] for r in text_lines(spark, str(tmp_path), strict).collect()) == want
    (tmp_path / "bad.txt").write_bytes(b"good\n\xff\xfe\n")
    assert sorted(r[0] for r in text_lines(spark, str(tmp_path), True).collect()) == want
    assert text_lines(spark, str(tmp_path)).count() == len(want) + 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text_lines(spark, str(tmp_path / "none"))


def test_tsv_pairs(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("b\t1\t2\n\nnotab\na\t\né\tx\r\n".encode())
    rows = {r["key"]: (r["value"], r["line"]) for r in tsv_pairs(spark, str(tmp_path)).collect()}
    assert rows == {"b": ("1\t2", "b\t1\t2"), "notab": (None, "notab"), "a": ("", "a\t"), "é": ("x", "é\tx")}


def test_json_lines_strict_and_lenient(spark, tmp_path):
    good = '{"k": "a", "n": 1, "extra": true}\n'
    (tmp_path / "g.jsonl").write_text(good)
    schema = "k STRING, n SMALLINT"
    assert [tuple(r) for r in json_lines(spark, str(tmp_path), schema).collect()] == [("a", 1)]
    for bad in ('{"k": "b"}\n', '{"k": "b", "n": 99999}\n', "{oops\n"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception):
            json_lines(spark, str(tmp_path), schema).collect()
        assert [tuple(r) for r in json_lines(spark, str(tmp_path), schema, lenient=True).collect()] == [("a", 1)]


def test_parquet_types(spark, tmp_path):
    table = pa.table({
        "u64": pa.array([2**63 + 5, 7, None], pa.uint64()), "i8": pa.array([1, -1, None], pa.int8()), "f": pa.array([0.1, 2.0, None], pa.float32()),
        "s": ["a", "b", None], "l": pa.array([[1], [], None], pa.list_(pa.int32())), "b": pa.array([b"\xff", b"", None], pa.binary()),
    })
    pq.write_table(table, tmp_path / "t.parquet")
    df = normalised(parquet_rows(spark, str(tmp_path), ["u64", "i8", "f", "s", "l", "absent"]))
    assert dict(df.dtypes) == {"u64": "bigint", "i8": "bigint", "f": "double", "s": "string", "l": "array<int>"}
    first = df.where("s = 'a'").first()
    assert (first["u64"], first["i8"], first["f"], first["l"]) == (-9223372036854775803, 1, 0.10000000149011612, [1])
    assert len(parquet_rows(spark, str(tmp_path)).columns) == 6
    plan = parquet_rows(spark, str(tmp_path), ["s"]).where("s = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s:string>" in plan and "EqualTo(s,a)" in plan


def test_parquet_sink(spark, tmp_path):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    df = spark.createDataFrame([(1, "x", when)], "z int, a string, t timestamp")
    schema = {"z": "double", "a": "string", "t": "timestamp_micros", "gone": "bytes"}
    sinks.write_parquet(df, str(tmp_path / "o"), schema)
    back = parquet_rows(spark, str(tmp_path / "o"))
    assert back.columns == ["a", "gone", "t", "z"] and tuple(back.first()) == ("x", None, when, 1.0)
    sinks.write_parquet(df, str(tmp_path / "o"), schema, plain_micros=True)
    assert dict(parquet_rows(spark, str(tmp_path / "o")).dtypes)["t"] == "bigint"
    with pytest.raises(TypeError):
        sinks.sink_rows(df, {"a": "int64"})
    with pytest.raises(ValueError, match="holds an input"):
        sinks.write_parquet(back, str(tmp_path / "o"))


def test_json_and_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é\n\"q\"", None, [1])], "b string, a int, c array<int>")
    sinks.write_json_lines(df, str(tmp_path / "j"), "b", "a", "c")
    assert [r[0] for r in text_lines(spark, str(tmp_path / "j")).collect()] == ['{"b":"é\\n\\"q\\"","a":null,"c":[1]}']
    sinks.write_text(spark.createDataFrame([], "value string"), str(tmp_path / "e"))
    assert text_lines(spark, str(tmp_path / "e")).count() == 0


def test_binary_records(spark, tmp_path):
    schema = "i bigint, n int, d double, b boolean, s string"
    rows = [(1, 2, 0.5, True, "é"), (None, None, None, None, None), (-(2**62), -1, 1e300, False, "")]
    df = spark.createDataFrame(rows, schema)
    sinks.write_records(df, str(tmp_path / "r"))
    sinks.write_records(df, str(tmp_path / "r"))  # overwrites
    assert {tuple(r) for r in binary_records(spark, str(tmp_path / "r"), df.schema).collect()} == set(rows)
    kinds = ["bigint", "string"]
    good, broken = encode((7, "x"), kinds), struct.pack("<I", 3) + b"\x01\x02\x03"
    assert list(decode(good + broken + good + good[:-1], kinds)) == [(7, "x"), (7, "x")]
    with pytest.raises(ValueError):
        binary_records(spark, str(tmp_path), "a array<int>")


def test_plug_ins(spark, tmp_path):
    from millrace import plugins

    held = {"a": b"1,x\n2,y\n", "b": b"", "c": b"3,z\n"}
    plugins.register_source("mem", lambda uri: sorted(held), lambda split: held[split])
    plugins.register_format("commas", lambda raw: [(int(a), b) for a, b in (x.split(",") for x in raw.decode().split())], "n int, s string")
    assert sorted(map(tuple, plugins.read(spark, "mem://all", "commas").collect())) == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.csv").write_bytes(held["a"])
    (tmp_path / "in" / "_skipped").write_text("no")
    assert plugins.read(spark, str(tmp_path / "in"), "commas").count() == 2
    with pytest.raises(FileNotFoundError):
        plugins.read(spark, str(tmp_path / "gone"), "commas")
    (tmp_path / "empty").mkdir()
    assert plugins.read(spark, str(tmp_path / "empty"), "commas").count() == 0
    rows = plugins.record_rows(spark, ["a", "bb"], lambda r: {"s": r, "n": len(r)}, "n int, s string, gone double")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", None), (2, "bb", None)]


def test_outputs_never_replace_inputs_by_any_name(spark, tmp_path):
    from millrace import sinks
    from millrace.sources import paths, prefix

    spark.range(3).write.parquet(str(tmp_path / "in" / "x"))
    df = spark.read.parquet(str(tmp_path / "in" / "x"))
    assert [r.rsplit("/", 1)[-1] for r in sinks.input_roots(df.where("id > 0").join(spark.range(2), "id"))] == ["x"]
    for out in (f"file://{tmp_path}/in", str(tmp_path / "in" / "x")):
        with pytest.raises(ValueError, match="holds an input"):
            sinks.write_parquet(df, out)
    with pytest.raises(ValueError, match="holds an input"):
        sinks.write_parquet(df, "s3a://bucket/in", inputs=["s3://bucket/in/x"])
    assert prefix("s3://b/foo") == "s3a://b/foo*" and paths("/x") == ["/x"]
