"""The reference operators' queries over the driver's tables: name -> query, and the DuckDB SQL for the same rows."""

from __future__ import annotations

import json
import uuid as _uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import plugins, sinks
from millrace.functions.checks import int32, non_empty, required, within
from millrace.functions.keys import length_first, partition_number, uuid
from millrace.functions.tokens import quoted_tsv, tokens
from millrace.operators.counting import grouped, word_count
from millrace.operators.lookup import lookup_join
from millrace.operators.mapreduce import Pipeline
from millrace.operators.nesting import nest
from millrace.operators.pairs import sample_pairs, sample_pairs_joined
from millrace.operators.sorting import first_per_group, sort_by_key, sort_parts
from millrace.plans import programs
from millrace.session import shared_dir
from millrace.sources.jsonl import json_lines
from millrace.sources.parquet import normalised, parquet_rows
from millrace.sources.records import binary_records
from millrace.sources.text import text_lines, tsv_pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return parquet_rows(spark, f"{d}/{name}.parquet", list(columns))


def _scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/roundtrip-{_uuid.uuid4().hex}"


_WORDS = "SELECT lower(w) AS word{1} FROM (SELECT unnest(regexp_extract_all({0}, '[A-Za-z0-9_'']+')) AS w{1} FROM {2})"


def _words(column: str, table: str, more: str = "") -> str:
    return _WORDS.format(column, more, table)


@_query(f"SELECT word, count(*) AS count FROM ({_words('text', 'documents')}) GROUP BY word")
def wordcount_documents(spark: SparkSession, d: str) -> DataFrame:
    return word_count(_table(spark, d, "documents", "text"), "text")


@_query(f"SELECT word, count(*) AS count FROM ({_words('html', 'pages')}) GROUP BY word")
def wordcount_pages_html(spark: SparkSession, d: str) -> DataFrame:
    return word_count(_table(spark, d, "pages", "html"), "html")


@_query(f"SELECT role, word, count(*) AS count FROM ({_words('text', 'conversations', ', role')}) GROUP BY role, word")
def wordcount_conversations_by_role(spark: SparkSession, d: str) -> DataFrame:
    return word_count(_table(spark, d, "conversations", "role", "text"), "text", ["role"])


@_query(f"SELECT '\"' || word || '\"' || chr(9) || count(*)::varchar AS line FROM ({_words('p_name', 'part')}) GROUP BY word")
def wordcount_tsv_line(spark: SparkSession, d: str) -> DataFrame:
    return word_count(_table(spark, d, "part", "p_name"), "p_name").select(quoted_tsv(F.col("word"), F.col("count")).alias("line"))


@_query("SELECT doc_id, lang, source FROM documents")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents", "doc_id", "lang", "source", "no_such_column")


@_query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL AND length(l_returnflag) > 0 AND l_linenumber BETWEEN 2 AND 5")
def filter_required(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return rows.where(non_empty(F.col("l_returnflag")) & F.col("l_linenumber").between(2, 5))


@_query("SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, '') AS country FROM documents")
def coalesce_default(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents", "doc_id", "lang").select("doc_id", F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), F.lit("")).alias("country"))


@_query("SELECT l_orderkey, CASE WHEN l_linenumber <= 3 THEN 'positive' WHEN l_linenumber >= 4 THEN 'negative' END AS side, count(*) AS n FROM lineitem GROUP BY ALL")
def range_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = within(required(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey"), "l_linenumber", 0, 255)
    side = F.when(F.col("l_linenumber") <= 3, "positive").when(F.col("l_linenumber") >= 4, "negative")
    return rows.groupBy("l_orderkey", side.alias("side")).agg(F.count("*").alias("n"))


@_query("SELECT l.doc_id, l.quality, d.text FROM labels l JOIN documents d USING (doc_id)")
def lookup_join_inner(spark: SparkSession, d: str) -> DataFrame:
    return lookup_join(_table(spark, d, "labels", "doc_id", "quality"), _table(spark, d, "documents", "doc_id", "text"), "doc_id", "doc_id", "text")


@_query("SELECT p.p_partkey, p.p_name, x.l_suppkey FROM part p JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) x ON p_partkey = l_partkey")
def lookup_join_dedup_build(spark: SparkSession, d: str) -> DataFrame:
    return lookup_join(_table(spark, d, "part", "p_partkey", "p_name"), _table(spark, d, "lineitem", "l_partkey", "l_suppkey"), "p_partkey", "l_partkey", "l_suppkey", policy="min")


@_query("SELECT p.p_partkey, x.l_returnflag FROM part p JOIN (SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY 1) x ON p_partkey = l_partkey")
def lookup_join_first(spark: SparkSession, d: str) -> DataFrame:
    right = _table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return lookup_join(_table(spark, d, "part", "p_partkey"), right, "p_partkey", "l_partkey", "l_returnflag", policy="first", order=["l_orderkey", "l_linenumber", "l_suppkey"])


@_query("SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN (SELECT doc_id, nullif(lang, 'en') AS lang FROM documents) d USING (doc_id) WHERE d.lang IS NOT NULL AND d.lang <> ''")
def lookup_join_nonempty(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents", "doc_id", "lang").withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")))
    return lookup_join(_table(spark, d, "labels", "doc_id", "quality"), docs, "doc_id", "doc_id", "lang", skip_empty=True)


@_query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    """The small side is broadcast by Catalyst, as its size is under the threshold; a larger one would be shuffled."""
    rows = _table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    return lookup_join(rows, _table(spark, d, "nation", "n_nationkey", "n_name"), "c_nationkey", "n_nationkey", "n_name", unique=True).drop("c_nationkey")


@_query("SELECT 'customer' AS tag, c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier")
def multi_input_union(spark: SparkSession, d: str) -> DataFrame:
    shape = lambda p, k: lambda df: df.select(F.col(f"{p}_{k}").alias("key"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("acctbal"))
    return Pipeline().input(_table(spark, d, "customer"), shape("c", "custkey"), "customer").input(_table(spark, d, "supplier"), shape("s", "suppkey"), "supplier").frame


@_query("SELECT tag, nationkey, count(*) AS n FROM (SELECT 'customer' AS tag, c_nationkey AS nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL")
def tagged_union_counts(spark: SparkSession, d: str) -> DataFrame:
    pipe = Pipeline().input(_table(spark, d, "customer"), lambda df: df.select(F.col("c_nationkey").alias("nationkey")), "customer")
    pipe.input(_table(spark, d, "supplier"), lambda df: df.select(F.col("s_nationkey").alias("nationkey")), "supplier")
    return pipe.reduce(["tag", "nationkey"], F.count("*").alias("n")).frame


@_query("SELECT l_returnflag, l_linestatus, sum(l_linenumber)::bigint AS total, sum(l_quantity::bigint)::bigint AS quantity FROM lineitem GROUP BY ALL")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return grouped(rows, ["l_returnflag", "l_linestatus"], total=F.sum("l_linenumber"), quantity=F.sum(F.col("l_quantity").cast("bigint")))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return grouped(_table(spark, d, "events", "event_type"), ["event_type"], n=F.count("*"))


@_query("SELECT DISTINCT o_custkey FROM orders")
def group_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return grouped(_table(spark, d, "orders", "o_custkey"), ["o_custkey"])


_NESTED = "to_json(list({{'l_partkey': l_partkey, 'l_linenumber': l_linenumber{0}}} ORDER BY l_partkey, l_linenumber{1}))::varchar"


@_query(f"SELECT l_orderkey, {_NESTED.format('', '')} AS docs FROM lineitem GROUP BY 1")
def nest_docs_json(spark: SparkSession, d: str) -> DataFrame:
    nested = nest(_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_partkey", "l_linenumber"], "docs")
    return nested.withColumn("docs", F.to_json("docs"))


@_query(f"SELECT l_orderkey, {_NESTED.format(chr(44) + ' ' + chr(39) + 'p_name' + chr(39) + ': p_name', ', p_name')} AS docs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def join_then_nest(spark: SparkSession, d: str) -> DataFrame:
    full = lookup_join(_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), _table(spark, d, "part", "p_partkey", "p_name"), "l_partkey", "p_partkey", "p_name")
    return nest(full, ["l_orderkey"], ["l_partkey", "l_linenumber", "p_name"], "docs").withColumn("docs", F.to_json("docs"))


@_query("SELECT l_orderkey, coalesce(string_agg(l_partkey::varchar, ',' ORDER BY l_partkey) FILTER (l_linenumber <= 3), '') AS pos, coalesce(string_agg(l_partkey::varchar, ',' ORDER BY l_partkey) FILTER (l_linenumber >= 4), '') AS neg FROM lineitem GROUP BY 1")
def group_split_pos_neg(spark: SparkSession, d: str) -> DataFrame:
    pos, key = F.col("l_linenumber") <= 3, F.col("l_partkey")
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    sides = grouped(rows, ["l_orderkey"], pos=F.collect_list(F.when(pos, key)), neg=F.collect_list(F.when(~pos & (F.col("l_linenumber") >= 4), key)))
    joined = lambda c: F.array_join(F.sort_array(c).cast("array<string>"), ",")
    return sides.select("l_orderkey", joined("pos").alias("pos"), joined("neg").alias("neg"))


@_query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderkey, o_orderpriority)) AS priority FROM orders GROUP BY 1")
def any_meta_deterministic(spark: SparkSession, d: str) -> DataFrame:
    return grouped(_table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], priority=F.min_by("o_orderpriority", F.struct("o_orderkey", "o_orderpriority")))


@_query("SELECT l_orderkey, count(*) FILTER (l_linenumber <= 3) AS pos FROM lineitem GROUP BY 1 HAVING pos > 0")
def having_positive(spark: SparkSession, d: str) -> DataFrame:
    return grouped(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], pos=F.count(F.when(F.col("l_linenumber") <= 3, 1))).where("pos > 0")


_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_PAIRS = """
    WITH main AS (
        SELECT *, CASE WHEN l_linenumber <= 3 THEN 'p' WHEN l_linenumber >= 4 THEN 'n' END AS side,
            md5(concat_ws('|', '0', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS draw
        FROM ({rows}) WHERE country IS NOT NULL AND body IS NOT NULL {more}
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY draw, body) AS rank FROM main
    ), groups AS (
        SELECT l_orderkey, max(CASE WHEN side = 'p' AND rank = 1 THEN body END) AS pos_doc,
            coalesce(list(body ORDER BY rank) FILTER (side = 'n' AND rank <= 4), []) AS neg_doc,
            arg_min(q || chr(10) || country, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS query
        FROM ranked GROUP BY l_orderkey
    )
    SELECT to_json({{'neg_doc': neg_doc, 'pos_doc': pos_doc, 'query': query}})::varchar AS line FROM groups WHERE pos_doc IS NOT NULL
"""
_RANKED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS q, {0} AS country{1} FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _ranking_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return _table(spark, d, "lineitem", *_TIE).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_orderpriority", "q")


@_query(_PAIRS.format(rows=_RANKED.format("nullif(o_orderstatus, 'P')", ", CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'part ' || l_partkey END AS body"), more=""))
def sample_pairs_one_stage(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("l_suppkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    rows = _ranking_rows(spark, d).select(*_TIE, "q", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("country"), body.alias("body"))
    made = sample_pairs(rows, group="l_orderkey", position="l_linenumber", body="body", tie=_TIE)
    return made.select(sinks.json_line(made, "neg_doc", "pos_doc", "query").alias("line"))


@_query(_PAIRS.format(rows=_RANKED.format("coalesce(nullif(o_orderstatus, 'P'), '')", ", nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END, '') AS body") + " JOIN part ON l_partkey = p_partkey", more="AND country <> ''"))
def sample_pairs_two_stage(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranking_rows(spark, d).select(*_TIE, "q", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("country"))
    docs = _table(spark, d, "part", "p_partkey", "p_name", "p_size").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("body"))
    made = sample_pairs_joined(rows, docs, key="l_partkey", body="body", group="l_orderkey", position="l_linenumber", tie=_TIE)
    return made.select(sinks.json_line(made, "neg_doc", "pos_doc", "query").alias("line"))


@_query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(_table(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@_query("SELECT c_name, c_custkey FROM customer")
def sort_by_key_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Globally sorted; the tests check the order, the SQL the rows."""
    return sort_by_key(_table(spark, d, "customer", "c_name", "c_custkey"), "c_name", "c_custkey")


@_query("SELECT o_orderkey, regexp_replace(md5(o_orderkey::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM orders")
def uuid_normalise(spark: SparkSession, d: str) -> DataFrame:
    digits = F.upper(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    form = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("{"), digits, F.lit("}"))).otherwise(digits)
    return _table(spark, d, "orders", "o_orderkey").select("o_orderkey", uuid(form).alias("uuid"))


#: crc32 of a key's digits: each digit is followed by eight shifts.
_CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(({0})::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


@_query(f"SELECT part, count(*) AS n FROM (SELECT ({_CRC32.format('o_orderkey')} % 16)::int AS part FROM orders) GROUP BY 1")
def hash_partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return grouped(_table(spark, d, "orders", "o_orderkey").select(partition_number(F.col("o_orderkey"), 16).alias("part")), ["part"], n=F.count("*"))


def _map_words(rows: Iterator[dict]) -> Iterator[tuple]:
    import re

    token = re.compile("[A-Za-z0-9_']+")  # once a partition
    for row in rows:
        for word in token.findall(row["p_name"] or ""):
            yield word.lower(), 1


def _reduce_words(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    yield key[0], sum(r["one"] for r in rows)


@_query(f"SELECT word, count(*) AS count FROM ({_words('p_name', 'part')}) GROUP BY word")
def generic_map_reduce_arrow(spark: SparkSession, d: str) -> DataFrame:
    pipe = Pipeline().input(_table(spark, d, "part", "p_name")).map(_map_words, "word string, one bigint")
    return pipe.reduce(["word"], reducer=_reduce_words, schema="word string, count bigint").frame


@_query(f"SELECT word, sum(one)::bigint AS count FROM (SELECT word, 1 AS one FROM ({_words('p_name', 'part')}) UNION ALL SELECT word, 1 FROM ({_words('r_name', 'region')})) GROUP BY word")
def generic_map_reduce_columns(spark: SparkSession, d: str) -> DataFrame:
    lift = lambda c: lambda df: df.select(F.col(c).alias("line"))
    pipe = Pipeline().input(_table(spark, d, "part"), lift("p_name")).input(_table(spark, d, "region"), lift("r_name"))
    return pipe.map(lambda df: df.select(F.explode(tokens("line")).alias("word"))).reduce(["word"], F.count("*").alias("count")).frame


@_query("SELECT event_id, user_id, event_type, props FROM events")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    sinks.write_json_lines(_table(spark, d, "events"), out, "event_id", "user_id", "event_type", "props")
    return json_lines(spark, out, "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING", need=["event_id"])


@_query(f"SELECT word, count(*) AS count FROM ({_words('p_name', 'part')}) GROUP BY word")
def text_roundtrip_wordcount(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    sinks.write_text(_table(spark, d, "part", "p_name"), out, line="p_name")
    return word_count(text_lines(spark, out), "value")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out, rows = _scratch(spark), _table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    sinks.write_records(rows, out)
    return binary_records(spark, out, rows.schema)


@_query("SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, l_quantity AS quantity, NULL::varchar AS absent, epoch_us(l_shipdate) AS shipped FROM lineitem")
def parquet_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").withColumnsRenamed({"l_quantity": "quantity", "l_shipdate": "shipped"})
    schema = {"l_orderkey": "int64", "l_linenumber": "int64", "quantity": "double", "absent": "string", "shipped": "timestamp_micros"}
    sinks.write_parquet(rows, out, schema, plain_micros=True)
    return normalised(parquet_rows(spark, out))


@_query("SELECT l_orderkey::int AS l_orderkey, l_linenumber FROM lineitem")
def cast_int32(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return rows.select(int32(F.col("l_orderkey").cast("bigint")).alias("l_orderkey"), "l_linenumber")


@_query("SELECT p_name, row_number() OVER (ORDER BY strlen(p_name), p_name, p_partkey) AS place FROM part")
def length_first_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of length-prefixed keys, as places."""
    place = F.row_number().over(Window.orderBy(*length_first(F.col("p_name")), "p_partkey"))
    return _table(spark, d, "part", "p_name", "p_partkey").select("p_name", place.cast("bigint").alias("place"))


@_query("SELECT count(*) AS n, 0::bigint AS out_of_order, 0::bigint AS split_keys FROM orders")
def sorted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Partitions sorted by key: how many rows stand before a lesser key, and how many keys are in several partitions."""
    rows = sort_parts(_table(spark, d, "orders", "o_custkey", "o_orderkey"), "o_custkey", 16).select("o_custkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = rows.withColumn("before", F.lag("o_custkey").over(Window.partitionBy("part").orderBy("at")))
    bad = before.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("before") > F.col("o_custkey"), 1)).alias("bad"), F.count_distinct("part").alias("parts"))
    return bad.agg(F.sum("n").alias("n"), F.sum("bad").alias("out_of_order"), F.count(F.when(F.col("parts") > 1, 1)).alias("split_keys"))


@_query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Broken lines and lines without a needed field are skipped."""
    out, rows = _scratch(spark), _table(spark, d, "events", "event_id", "event_type")
    whole = sinks.json_line(rows, "event_id", "event_type")
    broken = F.concat(F.lit("{"), whole)
    sinks.write_text(rows.select(F.when(F.col("event_id") % 7 == 0, broken).when(F.col("event_id") % 5 == 0, F.lit('{"event_type":"x"}')).otherwise(whole).alias("value")), out)
    return json_lines(spark, out, "event_id BIGINT, event_type STRING", lenient=True)


@_query("SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || chr(9) || c_mktsegment || chr(9) || c_custkey END AS line, c_name AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || chr(9) || c_custkey END AS value FROM customer WHERE c_custkey % 4 <> 0")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """The key ends at the first tab, a line without one is all key, blank lines go."""
    out, rows = _scratch(spark), _table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    full = F.concat_ws("\t", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    sinks.write_text(rows.select(F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(full).alias("value")), out)
    return tsv_pairs(spark, out)


@_query("SELECT n_name AS value FROM nation")
def overwritten_output(spark: SparkSession, d: str) -> DataFrame:
    """A second job's output replaces the first's, and readers tolerate parts without rows."""
    out = _scratch(spark)
    sinks.write_text(_table(spark, d, "customer", "c_name"), out, line="c_name")
    sinks.write_text(_table(spark, d, "nation", "n_name").repartition(64), out, line="n_name")
    return text_lines(spark, out)


def _json_records(content: bytes) -> Iterator[tuple]:
    for line in content.splitlines():
        row = json.loads(line)
        yield row["key"], row["name"]


def _json_part(folder: str, number: int):  # noqa: ANN202
    held: list[tuple] = []

    def put(row: tuple | None) -> None:
        from pyarrow import fs

        if row is not None:
            held.append(row)
            return
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/part-{number:05d}.jsonl") as out:
            out.write("".join(json.dumps({"key": k, "name": n}) + "\n" for k, n in held).encode())

    return put


@_query("SELECT s_suppkey AS key, s_name AS name FROM supplier")
def plugged_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Out through a sink of one's own, in through a format of one's own."""
    out = _scratch(spark)
    out = out if "://" in out else f"file://{out.removeprefix('file:')}"
    rows = _table(spark, d, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").cast("bigint").alias("key"), F.col("s_name").alias("name"))
    plugins.write(rows, out, "json_parts", _json_part)
    plugins.register_format("json_records", _json_records, "key bigint, name string")
    return plugins.read(spark, out, "json_records")


@_query(f"SELECT '\"' || word || '\"' || chr(9) || count(*)::varchar AS line FROM ({_words('p_name', 'part')}) GROUP BY word")
def program_wordcount(spark: SparkSession, d: str) -> DataFrame:
    lines, out = _scratch(spark), _scratch(spark)
    sinks.write_text(_table(spark, d, "part", "p_name"), lines, line="p_name")
    programs.wordcount_text(spark, lines, out)
    return text_lines(spark, out).withColumnRenamed("value", "line")


@_query(f"SELECT count(*) AS count, word FROM ({_words('text', 'documents')}) GROUP BY word")
def program_wordcount_parquet(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    programs.wordcount_parquet(spark, f"{d}/documents.parquet", out, column="text")
    return parquet_rows(spark, out)


def _file_each(folder: str, number: int):  # noqa: ANN202
    def put(row: tuple | None) -> None:
        from pyarrow import fs

        if row is None:
            return
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{top}/{row[0] % 3}", recursive=True)
        with files.open_output_stream(f"{top}/{row[0] % 3}/{row[0]}.txt") as out:
            out.write(bytes(row[1]))

    return put


@_query("SELECT n_name AS value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT '' FROM nation WHERE n_nationkey % 2 = 0")
def strict_utf8_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in nested folders, with CR LF and blank lines; those that aren't valid UTF-8 give no line."""
    out = _scratch(spark)
    out = out if "://" in out else f"file://{out.removeprefix('file:')}"
    content = F.concat(F.encode(F.col("n_name"), "UTF-8"), F.expr("X'0D0A0A'"), F.when(F.col("n_nationkey") % 2 == 0, F.expr("X''")).otherwise(F.expr("X'FF'")))
    plugins.write(_table(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", content.alias("raw")), out, "files", _file_each)
    return text_lines(spark, out, strict_utf8=True)


_UUID = "regexp_replace(md5({0}::varchar), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_FOUND = f"SELECT o_orderpriority AS query, {_UUID.format('c_custkey')} AS page_uuid, o_orderkey % 256 AS position, c_name AS body FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0"


def _searches_and_pages(spark: SparkSession, d: str) -> tuple[str, str]:
    """JSON Lines of searches (keys in braces and upper case) and of pages (plain keys; every ninth page twice)."""
    searches, pages = _scratch(spark), _scratch(spark)
    digits = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    left = _table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    left = left.select(F.col("o_orderpriority").alias("query"), F.concat(F.lit("{"), F.upper(digits("o_custkey")), F.lit("}")).alias("page_uuid"), (F.col("o_orderkey") % 256).alias("position"))
    right = _table(spark, d, "customer", "c_custkey", "c_name").where("c_custkey % 3 <> 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.when(F.col("c_custkey") % 9 == 1, 1).otherwise(0))))
    right = right.select(digits("c_custkey").alias("page_uuid"), F.when(F.col("n") == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" again"))).alias("body"))
    sinks.write_json_lines(left, searches)
    sinks.write_json_lines(right, pages)
    return searches, pages


@_query(f"SELECT to_json({{'query': query, 'page_uuid': page_uuid, 'position': position, 'body': body}})::varchar AS line FROM ({_FOUND})")
def program_join(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    programs.join(spark, *_searches_and_pages(spark, d), out)
    return text_lines(spark, out).withColumnRenamed("value", "line")


@_query(f"SELECT to_json({{'query': query, 'docs': list({{'page_uuid': page_uuid, 'position': position, 'body': body}} ORDER BY page_uuid, position, body)}})::varchar AS line FROM ({_FOUND}) GROUP BY query")
def program_join_nested(spark: SparkSession, d: str) -> DataFrame:
    """In two steps, with a table between them that goes in the end."""
    out = _scratch(spark)
    programs.join_nested(spark, *_searches_and_pages(spark, d), out, stage=_scratch(spark))
    return text_lines(spark, out).withColumnRenamed("value", "line")


_RANKING = """
    WITH main AS (
        SELECT l_orderkey AS qid, l_linenumber AS position, o_orderpriority AS q, o_orderstatus AS country, p_name AS body,
            CASE WHEN l_linenumber <= 3 THEN 'p' ELSE 'n' END AS side, md5(concat_ws('|', '0', l_linenumber, {tie})) AS draw, {tie} AS tie
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P'
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY draw, body) AS rank FROM main)
    SELECT to_json({{'neg_doc': coalesce(list(body ORDER BY rank) FILTER (side = 'n' AND rank <= 4), []), 'pos_doc': max(body) FILTER (side = 'p' AND rank = 1),
        'query': arg_min(q || chr(10) || country, (position, tie))}})::varchar AS line
    FROM ranked GROUP BY qid HAVING count(*) FILTER (side = 'p') > 0
"""


def _ranking_inputs(spark: SparkSession, d: str, bodies: bool) -> tuple[str, str]:
    """Two folders of the main input, as one comma-separated name, and one of the documents."""
    one, two, docs = _scratch(spark), _scratch(spark), _scratch(spark)
    body = _table(spark, d, "part", "p_partkey", "p_name").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page_uuid"), F.col("p_name").alias("body_full"))
    orders = _table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("l_orderkey").alias("qid"), F.col("o_orderpriority").alias("q"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("country"),
        F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("page_uuid"),
    )
    if bodies:
        rows = rows.join(body, "page_uuid")
    else:
        body.write.parquet(docs)
    rows.where("qid % 2 = 0").write.parquet(one)
    rows.where("qid % 2 <> 0").write.parquet(two)
    return f"{one},{two}", docs


@_query(_RANKING.format(tie="p_name"))
def program_ranking_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    sources, _ = _ranking_inputs(spark, d, bodies=True)
    programs.ranking_pairs(spark, sources, out)
    return text_lines(spark, out).withColumnRenamed("value", "line")


@_query(_RANKING.format(tie="'p' || l_partkey"))
def program_ranking_pairs_two_stage(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark)
    sources, docs = _ranking_inputs(spark, d, bodies=False)
    programs.ranking_pairs(spark, sources, out, docs)
    return text_lines(spark, out).withColumnRenamed("value", "line")


@_query("SELECT row_number() OVER (ORDER BY key, line) - 1 AS place, line FROM (SELECT p_brand AS key, p_brand || chr(9) || p_partkey AS line FROM part)")
def program_sort_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The single sorted file, with each line's place in it."""
    lines, out = _scratch(spark), _scratch(spark)
    rows = _table(spark, d, "part", "p_brand", "p_partkey")
    sinks.write_text(rows.select(F.concat_ws("\t", "p_brand", F.col("p_partkey").cast("string")).alias("value")), lines)
    programs.sort_tsv(spark, lines, out, single=True)
    return text_lines(spark, out).coalesce(1).select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
