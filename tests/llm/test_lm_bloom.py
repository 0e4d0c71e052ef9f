import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_bloom
from millrace.llm.text import fold_remainder
from tests.llm.helpers import docs
from tests.llm.test_minhash_dedup import WORD

ODD = [None, "", " \n", "One ONE one", "É é K K", "x" * 100 + " " + "x" * 100, "never seen before words zzz", "word " * 20_000]


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), ""]


def texts_of(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()] + ODD


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_base_equals_brute_force_and_a_filter_too_large_to_broadcast_scores_alike(spark):
    texts = texts_of(spark)
    c = Counter(t for i, x in enumerate(texts) if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    d = docs(spark, texts)
    d = d.union(d.where("doc_id in (3, 200, 206)"))
    learn = fold_remainder(F.col("doc_id"), 5) != 1
    # The repeated rows are learned from as well.
    for i in (3, 200, 206):
        if not held(i):
            c.update(tokens(texts[i]))
    n, v = sum(c.values()), len(c)
    whole = lm_bloom.train_and_score(d, learn, head_words=500).collect()
    assert len(whole) == len(texts) + 3
    for r in whole:
        t = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[x] > 0 for x in t), n)
        assert close(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert -np.inf < r["score"] <= 0
    small = {r["doc_id"]: r for r in lm_bloom.train_and_score(d, learn, head_words=500, max_broadcast=lm_bloom.BLOCK // 8).collect()}
    for r in whole:
        assert close(r["score"], small[r["doc_id"]]["score"]) and close(r["base_score"], small[r["doc_id"]]["base_score"])


def test_filter_reads_levels_back(spark):
    rng = np.random.default_rng(5)
    keys, levels = rng.integers(-(2**63), 2**63, 20_000), rng.integers(1, 12, 20_000)
    blocks = -(-int(levels.sum()) * lm_bloom.BITS_PER_ENTRY // lm_bloom.BLOCK)
    table = lm_bloom.build(spark.createDataFrame(zip(keys.tolist(), levels.tolist()), "h long, level int"), blocks)
    part = lm_bloom._whole(lm_bloom.Model(None, table, blocks, 0, 0, 0.0, 0))
    got = part.levels(keys.view(np.uint64))
    assert (got >= levels).all() and (got > levels).mean() < 0.03
    assert (part.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.03


def test_scores_beat_the_base_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = fold_remainder(F.col("doc_id"), 5) == 1
    r = lm_bloom.train_and_score(d, ~held_out).where(held_out).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["s"] > r["b"]


def level(c):
    return int(c).bit_length()


def middle(c):
    return (2 ** (level(c) - 1) + 2 ** level(c) - 1) / 2 if c else 0.0


def brute_score(text, words, pairs, documents, head):
    """log10 of the model's probability of a text, from exact counts."""
    total, out, before = sum(map(middle, words.values())) + 0.5 * (len(words) + 1), 0.0, None
    for w in tokens(text):
        c_v = documents if before is None else words[before]
        seen = c_v if before is None or before in head else 2 ** level(c_v) - 1
        at = min(level(pairs[before, w]), level(c_v), level(words[w]))
        alone = (middle(words[w]) + 0.5) / total
        out += math.log10(lm_bloom.WEIGHT * min(2 ** (at - 1) if at else 0, seen) / seen + (1 - lm_bloom.WEIGHT) * alone if seen else alone)
        before = w
    return out


@pytest.mark.parametrize("head_words", [0, 1 << 17])
def test_scores_equal_brute_force(spark, monkeypatch, head_words):
    monkeypatch.setattr(lm_bloom, "BITS_PER_ENTRY", 200)  # next to no chance hits
    texts = texts_of(spark)
    words, pairs, documents = Counter(), Counter(), 0
    for i, x in enumerate(texts):
        if not held(i):
            t = tokens(x)
            words.update(t)
            pairs.update(zip([None, *t], t, strict=False))
            documents += 1
    head = set(words) if head_words else set()
    got = lm_bloom.train_and_score(docs(spark, texts), fold_remainder(F.col("doc_id"), 5) != 1, head_words=head_words).collect()
    off = [r["doc_id"] for r in got if not math.isclose(r["score"], brute_score(texts[r["doc_id"]], words, pairs, documents, head), rel_tol=1e-9)]
    assert len(got) == len(texts) and len(off) <= 1


def test_probabilities_after_any_history_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        follows = rng.zipf(1.6, n).clip(0, 5000) * (rng.random(n) < 0.8)
        words = follows + rng.integers(1, 20, n) * rng.integers(0, 2, n)
        c_v = int(follows.sum()) + 1
        total = sum(map(middle, words)) + 0.5 * (n + 1)
        # Pairs count at least half of what they are, and a history that isn't known exactly up to twice.
        for seen, least in ((c_v, 0.5), (2 ** level(c_v) - 1, 0.25)):
            p = [lm_bloom.probabilities(np.array([level(c_v), level(w)]), np.array([0, level(c)]), np.array([0]), np.array([seen, 0.0]), 9, total)[1] for w, c in zip(words, follows, strict=True)]
            unseen = lm_bloom.probabilities(np.array([level(c_v), 0]), np.array([0, 0]), np.array([0]), np.array([seen, 0.0]), 9, total)[1]
            assert 1 - lm_bloom.WEIGHT * (1 - least * (c_v - 1) / c_v) - 1e-9 <= sum(p) + unseen <= 1 + 1e-9


def test_empty(spark):
    assert lm_bloom.train_and_score(docs(spark, []), F.lit(True)).count() == 0
    r = lm_bloom.train_and_score(docs(spark, ["a b"]).selectExpr("*", "1 as c", "2 as token"), F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0, 0)


def test_pairs_seen_once_are_evidence_and_twice_are_more(spark):
    # Trained on two documents, "a b" and "c d": words seen once each, the end twice (middle 2.5).
    d = docs(spark, ["a b", "c d", "a b", "a d", "c d"])
    got = {r["doc_id"]: r["score"] for r in lm_bloom.train_and_score(d, F.col("doc_id") < 2).collect()}
    alone = 1.5 / (4 + 2.5 + 0.5 * 6)
    assert close(got[2] - got[3], math.log10((0.3 + 0.7 * alone) / (0.7 * alone)))
    twice = {r["doc_id"]: r["score"] for r in lm_bloom.train_and_score(d, F.col("doc_id").isin(0, 1, 4)).collect()}
    assert twice[1] > twice[0]


def test_one_text_in_very_many_rows(spark):
    d = docs(spark, ["a b c"] * 3000 + ["a b d"])
    got = lm_bloom.train_and_score(d, F.lit(True), max_broadcast=0).groupBy("n_tokens", "n_known", "score").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3000]


def test_a_filter_too_large_to_broadcast_writes_no_more_than_twice_the_input(spark, monkeypatch):
    import os
    from urllib.parse import urlparse

    path, written, write = "/root/testdata/sf0.01/documents.parquet", Counter(), lm_bloom.Tables.write

    def seen(self, df, name, *a):
        table = write(self, df, name, *a)
        written[name] += sum(os.path.getsize(urlparse(f).path) for f in table.inputFiles())
        return table

    monkeypatch.setattr(lm_bloom.Tables, "write", seen)
    monkeypatch.setattr(lm_bloom, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(lm_bloom, "GROUP_BYTES", 1 << 18)
    d, learn = spark.read.parquet(path), fold_remainder(F.col("doc_id"), 5) != 1
    joined = lm_bloom.train_and_score(d, learn, max_broadcast=0)
    of_model = ("counts", "entries", "filter", "scored")
    assert sum(n for k, n in written.items() if k not in of_model) < 2 * os.path.getsize(path), written
    whole = {r["doc_id"]: r for r in lm_bloom.train_and_score(d, learn).collect()}
    got = joined.collect()
    assert len(got) == len(whole) == d.count()
    for r in got:
        assert r["n_known"] == whole[r["doc_id"]]["n_known"] and close(r["score"], whole[r["doc_id"]]["score"]) and close(r["base_score"], whole[r["doc_id"]]["base_score"])
