import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace import cli
from millrace.plans import queries

U = "00000000-0000-0000-0000-00000000000"


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_wordcount(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\nThe dog's cat\n")
    cli.main(["wordcount", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--single"])
    assert lines(tmp_path / "out") == ['"cat"\t2', '"dog\'s"\t1', '"the"\t2']
    pq.write_table(pa.table({"line": ["a b", None, "B"]}), tmp_path / "in" / "x.parquet")
    cli.main(["wordcount-parquet", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "pq")])
    got = spark.read.parquet(str(tmp_path / "pq"))
    assert got.columns == ["count", "word"] and {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b")}


def test_join_programs(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [{"query": "q1", "page_uuid": U + "1", "position": 2}, {"query": "q1", "page_uuid": "{" + U + "2}", "position": 0}, {"query": "q2", "page_uuid": U + "9", "position": 255}]))
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [{"page_uuid": U.upper() + "1", "body": "one é"}, {"page_uuid": U + "2", "body": "two"}, {"page_uuid": U + "2", "body": "two again"}, {"page_uuid": U + "3", "body": "unused"}]))
    for program in ("join", "join-nested"):
        cli.main([program, "--searches", str(tmp_path / "s.jsonl"), "--pages", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / program), "--single"])
    one, two = {"page_uuid": U + "1", "position": 2, "body": "one é"}, {"page_uuid": U + "2", "position": 0, "body": "two"}
    got = [json.loads(x) for x in lines(tmp_path / "join")]
    assert got == [{"query": "q1", **one}, {"query": "q1", **two}] and list(got[0]) == ["query", "page_uuid", "position", "body"]
    assert [json.loads(x) for x in lines(tmp_path / "join-nested")] == [{"query": "q1", "docs": [one, two]}]
    (tmp_path / "s.jsonl").write_text('{"query": "q", "page_uuid": "' + U + '1", "position": 256}\n')
    with pytest.raises(Exception, match="out of range"):
        cli.main(["join", "--searches", str(tmp_path / "s.jsonl"), "--pages", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "o")])


def test_ranking_and_sort_programs(spark, tmp_path):
    main = pa.table({"qid": ["a", "a", "a"], "q": ["q"] * 3, "country": ["us"] * 3, "position": pa.array([1, 5, 6], pa.int32()), "page_uuid": ["p1", "p2", "p3"], "body_full": ["b1", "b2", "b3"]})
    pq.write_table(main, tmp_path / "m.parquet")
    pq.write_table(pa.table({"page_uuid": ["p1", "p2"], "body_full": ["d1", "d2"]}), tmp_path / "d.parquet")
    cli.main(["ranking-pairs", "--input", str(tmp_path / "m.parquet"), "--output", str(tmp_path / "one"), "--num-negatives", "1"])
    (row,) = [json.loads(x) for x in lines(tmp_path / "one")]
    assert row["pos_doc"] == "b1" and len(row["neg_doc"]) == 1 and row["query"] == "q\nus" and list(row) == ["neg_doc", "pos_doc", "query"]
    cli.main(["ranking-pairs", "--input", str(tmp_path / "m.parquet"), "--doc-input", str(tmp_path / "d.parquet"), "--output", str(tmp_path / "two")])
    assert [json.loads(x) for x in lines(tmp_path / "two")] == [{"neg_doc": ["d2"], "pos_doc": "d1", "query": "q\nus"}]
    (tmp_path / "t.tsv").write_text("b\t1\n\na\t2\nZ\n")
    cli.main(["sort-tsv", "--input", str(tmp_path / "t.tsv"), "--output", str(tmp_path / "sorted"), "--single"])
    assert lines(tmp_path / "sorted") == ["Z", "a\t2", "b\t1"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(map(str, ([r[i] for i in order] for r in rows)))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_equal_duckdb(spark, name):
    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    if sql := queries.ORACLE_SQL.get(name):
        with duckdb.connect() as db:
            for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
            found = db.execute(sql)
            columns = [c[0] for c in found.description]
            assert sorted(columns) == sorted(df.columns)
            assert _rows(df.columns, rows) == _rows(columns, found.fetchall())


def test_sorted_query_is_in_order(spark):
    keys = [r["c_name"] for r in queries.QUERIES["sort_by_key_bytes"](spark, "/root/testdata/sf0.001").collect()]
    assert keys == sorted(keys, key=str.encode)


def test_stage_table_and_stats(spark, tmp_path, capsys):
    (tmp_path / "s.jsonl").write_text(json.dumps({"query": "q1", "page_uuid": U + "1", "position": 2}) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"page_uuid": U + "1", "body": "one"}) + "\n")
    for keep in ([], ["--keep-stage"]):
        cli.main(["--stats", "--list-inputs", "--threads", "2", "join-nested", "--searches", str(tmp_path / "s.jsonl"), "--pages", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "out"), "--stage", str(tmp_path / "stage"), *keep])
        assert [json.loads(x)["query"] for x in lines(tmp_path / "out")] == ["q1"] and (tmp_path / "stage").exists() == bool(keep)
    said = capsys.readouterr().err.splitlines()
    assert any(json.loads(x)["rows_out"] == 1 for x in said if x.startswith("{")) and sum(x.endswith("s.jsonl") for x in said) == 2
