import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import exact_dedup
from tests.llm.helpers import SF, by_id, docs


def brute(texts):
    out, seen = {}, defaultdict(list)
    for i, t in texts.items():
        seen[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for norm, rows in seen.items():
        keep = min(rows)[1]
        for _, i in rows:
            out[i] = {"doc_id": i, "keep_id": keep, "group_size": len(rows), "kept": i == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()}
    return out


def test_equals_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    long = "".join(f"{i} é {i * i}\n" for i in range(30_000))
    texts += [None, "", " \t\r\n\x0b\x0c", "a b", "ab", "a\tb ", "a b", "aB", long, long.replace(" ", "  "), long + "x", "e" * 5000, "e" * 5001, "et" * 3000]
    texts += texts[:50]
    assert by_id(exact_dedup.exact_dedup(docs(spark, texts))) == brute(dict(enumerate(texts)))


def test_rows_that_stay(spark):
    d = docs(spark, ["a b", "ab", "c", None, ""]).selectExpr("*", "1 as kept", "2 as recipe", "3 as text_sha256")
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup_rows(d).collect()) == [0, 2, 3]
    twice = exact_dedup.exact_dedup_rows(d.union(d))
    assert sorted(r["doc_id"] for r in twice.collect()) == [0, 2, 3] and twice.columns == d.columns
    odd = d.selectExpr("if(doc_id = 2, null, doc_id) as doc_id", "text")
    assert len(exact_dedup.exact_dedup_rows(odd).collect()) == 3
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == exact_dedup.exact_dedup_rows(docs(spark, [])).count() == 0


def test_chunks_are_content_defined(spark):
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() + "et" for i in range(400))
    d = docs(spark, [text, "inserted" + text, "x" * 10_000, "short", ""])
    cut = {i: r["c"] for i, r in by_id(d.select("doc_id", exact_dedup.chunks(d["text"]).alias("c"))).items()}
    for i, t in enumerate([text, "inserted" + text, "x" * 10_000, "short", ""]):
        assert "".join(cut[i]) == t and all(len(c) <= exact_dedup.MAX_CHUNK for c in cut[i])
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0]) > 10


def test_identifiers_are_verified(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c, salt: [F.lit(1).cast("long"), F.lit(1).cast("long")] if salt < 2 else [F.xxhash64(c), F.lit(0).cast("long")])
    d = docs(spark, ["one", "two", "one "])
    assert exact_dedup.verified_salt(d, "text") == 2
    assert {i: r["keep_id"] for i, r in by_id(exact_dedup.exact_dedup(d)).items()} == {0: 2, 1: 1, 2: 2}


def test_an_id_with_several_texts_loses_only_copies(spark):
    d = docs(spark, ["one text", "one  text", "other", "only here", "other"]).selectExpr("case doc_id when 1 then 7 when 3 then 7 else doc_id end as doc_id", "text", "n_chars as _again")
    kept = sorted((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup_rows(d).collect())
    assert kept == [(2, "other"), (7, "one  text"), (7, "only here")]


def test_chunks_of_large_scripts_follow_their_content(spark):
    rng = random.Random(5)
    for lo, hi in ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x0430, 0x0450), (0x3041, 0x3096), (0x0905, 0x0939)):
        text = "".join(chr(rng.randrange(lo, hi)) for _ in range(9_000))
        rows = docs(spark, [text, "字" * 37 + text]).select(exact_dedup.chunks(F.col("text")).alias("c")).collect()
        one, two = (set(r["c"]) for r in rows)
        assert len(one & two) > 0.5 * len(one) and len(one) > 8
