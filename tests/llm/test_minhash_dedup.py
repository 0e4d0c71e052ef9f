import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import hashing, minhash_dedup
from millrace.llm.components import components
from millrace.llm.store import Tables
from tests.llm.helpers import by_id, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k=4):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for group in by.values() for n, a in enumerate(group) for b in group[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def run(spark, texts, **options):
    d = docs(spark, []).union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], docs(spark, []).schema))
    return {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(minhash_dedup.near_duplicates(d, words=4, **options)).items()}


def test_equals_brute_force_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    texts |= {5000: None, 5001: "", 5002: " \n", 5003: "one", 5004: "ONE", 5005: "a b c d e", 5006: "A b\tc D e", 5007: "É b c d e", 5008: "word " * 30_000}
    assert run(spark, texts) == brute(texts)


def test_large_group_of_unlike_texts_with_a_common_passage(spark):
    random.seed(3)
    word = lambda: f"w{random.randrange(10**6)}"
    common = [word() for _ in range(60)]
    texts = {}
    for i in range(150):
        texts[i] = " ".join(common + [word() for _ in range(random.randrange(6, 30))])
    base = [word() for _ in range(120)]
    for i in range(150, 260):
        edit = list(base)
        for _ in range(random.randrange(1, 4)):
            edit[random.randrange(120)] = word()
        texts[i] = " ".join(edit)
    want = brute(texts)
    assert run(spark, texts) == want
    assert run(spark, texts, star_rounds=1, small_group=2) == want


def near_copies(n, edits, seed, size=90):
    """Copies of one text, with some words of each replaced by words of its own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    texts = {}
    for i in range(n):
        text = list(base)
        for k in rng.sample(range(size), rng.choice(edits)):
            text[k] = f"e{i}x{k}"
        texts[i] = " ".join(text)
    return texts


def test_large_group_of_near_copies_some_of_which_are_too_far_apart(spark):
    # Each edit makes four of 87 shingles unlike: texts of up to two edits are mostly alike, those of five only reach some.
    texts = near_copies(200, [0, 1, 2, 3, 4, 5, 6], 11)
    # A second family that shares half of the base, so that it has edits in common.
    half = texts[0].split()[:45] + [f"h{k}" for k in range(45)]
    rng = random.Random(12)
    for i in range(200, 300):
        text = list(half)
        for k in rng.sample(range(90), rng.randrange(7)):
            text[k] = f"g{i}x{k}"
        texts[i] = " ".join(text)
    want = brute(texts)
    assert len({c for _, c, _ in want.values()}) > 20
    assert run(spark, texts) == want
    assert run(spark, texts, star_rounds=0, small_group=4) == want


def test_large_groups_cost_in_proportion(spark):
    def took(n):
        d = docs(spark, []).union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in near_copies(n, [0, 1, 2, 4, 5], 13).items()], docs(spark, []).schema)).repartition(8).cache()
        d.count()
        began = time.perf_counter()
        rows = minhash_dedup.near_duplicates(d, words=4).count()
        assert rows == n
        return time.perf_counter() - began

    small, large = took(1_000), took(4_000)
    assert large < 3 * small + 20  # the square would be 16


def test_a_very_long_text_of_distinct_words(spark):
    long = " ".join(f"n{i}" for i in range(300_000))
    texts = {0: long, 1: long + " more words at the end", 2: " ".join(f"n{i}" for i in range(150_000))}
    assert run(spark, texts) == {0: (299_997, 0, True), 1: (300_002, 0, False), 2: (149_997, 2, True)}


def test_word_hashes_and_estimate(spark):
    texts = [b"", b"a  b\n", "Straße STRASSE É".encode(), b"x" * 50, b"A B a"]
    hashes, begins, joined, starts, ends = hashing.words_of(texts)
    got = [joined[s:e] for s, e in zip(starts, ends)]
    assert got == [w.encode() for t in texts for w in WORD.findall(t.decode())]
    assert np.diff(begins).tolist() == [0, 2, 3, 1, 3] and hashes[-1] == hashes[-3] == hashes[0]
    old, hashing.STEP = hashing.STEP, 7
    try:
        assert (hashing.words(b"one two  three four fifteen6 7")[0] == [hashing.words(w)[0][0] for w in b"one two three four fifteen6 7".split()]).all()
    finally:
        hashing.STEP = old
    rng, a, b = np.random.default_rng(0), *minhash_dedup._functions()
    rows = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(40):
            n = int(400 * share / (1 + share) * 2)
            x = rng.integers(0, 2**63, 800 - n).astype(np.uint64)
            rows.append((share, *(minhash_dedup._packed(minhash_dedup._minima(s, a, b)) for s in (x[:400], x[400 - n :]))))
    df = spark.createDataFrame(rows, "share double, x array<long>, y array<long>").groupBy("share").agg(F.avg(minhash_dedup.estimate(F.col("x"), F.col("y"))).alias("e"))
    assert all(abs(r["share"] - r["e"]) < 0.03 for r in df.collect())


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000 + i, 900) for i in range(300)] + [(70, 71), (71, 70), (72, 72)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y", Tables(spark)).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 900 for i in range(300)} | {900: 900, 70: 70, 71: 70}


def test_edges(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e f", "a b c d e f", "x"]).selectExpr("if(doc_id = 2, null, doc_id) doc_id", "text", "1 as rep", "2 as key", "3 as id")
    got = minhash_dedup.near_duplicates(d.union(d)).collect()
    assert len(got) == 6 and [(r["component_id"], r["kept"]) for r in got if r["doc_id"] == 1] == [(0, False)] * 2
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
