import hashlib
import random
import re
import struct

import xxhash

from millrace.llm.order_minhash import LONG_WORD, RUN, edit_sensitivity, fingerprints
from tests.llm.helpers import SF, by_id, docs


def check(spark, rows):
    got = by_id(edit_sensitivity(docs(spark, []).union(spark.createDataFrame(rows, docs(spark, []).schema)) if rows else docs(spark, [])))
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for a, b in zip(order, order[1:] + order[:1]):
        text, other = a[1] or "", b[1] or ""
        n = len(text)
        want = text[: n - n // 2] + other[: n // 2]
        r = got[a[0]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest(), a[0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if want == text:
            assert r["near_edited"] == 1
        if text == other:
            assert r["near_next"] == 1
    return got


def test_neighbours_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()] + [None, "", "é", "日本語", "a", "a b"]
    random.seed(2)
    ids = random.sample(range(-(10**12), 10**12), len(texts) * 4)
    rows = [(i, texts[k % len(texts)], "en", "s", 1) for k, i in enumerate(ids)]
    got = check(spark, rows)
    assert sum(r["near_edited"] for r in got.values()) > 2 * sum(r["near_next"] for r in got.values())


def test_small_and_repeated(spark):
    assert len(check(spark, [(5, "one two three", "en", "s", 1)])) == 1
    check(spark, [(1, "a b c d", "en", "s", 1), (2, "x y z", "en", "s", 1)])
    assert edit_sensitivity(docs(spark, [])).count() == 0
    d = docs(spark, ["a b", None, "a b"]).selectExpr("*", "1 as fingerprint", "2 as p", "3 as own", "4 as next_text")
    assert edit_sensitivity(d.union(d)).count() == 6
    assert edit_sensitivity(d.selectExpr("if(doc_id = 1, null, doc_id) as doc_id", "text")).count() == 3


def test_order_and_occurrence_matter(spark):
    words = [f"w{i}" for i in range(400)]
    shuffled = words[200:] + words[:200]
    got = by_id(fingerprints(docs(spark, [" ".join(words), " ".join(shuffled), " ".join(words) + "\n", "a b a b a b", "a b a b", "long " * 30_000])))
    f = {i: set(r["fingerprint"].split()) for i, r in got.items()}
    assert f[0] == f[2] and f[3] != f[4]
    # The k-mers are the same but for two; their order differs where a bin's two lie on either side of the cut.
    assert 0.2 < len(f[0] & f[1]) / 64 < 0.8


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v, seed=h)
    return h


def brute_fingerprint(text, k=2, per_bin=2, bin_bits=6):
    """The same signature with lists and dictionaries, one k-mer at a time."""
    units = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        units += [w[i : i + RUN] for i in range(len(w) - RUN + 1)] if len(w) > LONG_WORD else [w]
    if not units:
        return ""
    seen, bins = {}, {}
    for i in range(max(len(units) - k, 0) + 1):
        kmer = chained(*[u.encode() for u in units[i : i + k]]) >> 24
        n = seen.get(kmer, 0)
        seen[kmer] = n + 1
        numbered = chained(struct.pack("<q", kmer), struct.pack("<i", n)) >> 24 << 24
        bins.setdefault(numbered >> 58, []).append((signed(numbered | i), i, numbered >> 24))
    out = []
    for b, found in bins.items():
        least = sorted(found)[:per_bin]
        values = [struct.pack("<q", h) for _, h in sorted((i, h) for _, i, h in least)]
        out.append(f"{b:03X}{chained(*values) & 0xFFFFFFFF:08X}")
    return " ".join(sorted(out))


def brute_likeness(a, b):
    x, y = set(a.split()), set(b.split())
    return 1.0 if a == b else len(x & y) / len({w[:3] for w in x | y})


def test_fingerprints_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    texts += ["", " \n", "one", "a a a a a", "x" * 24, "x" * 25 + " y", "今日は天気がいいので公園を散歩しましょう。そして本を読みます", "𝒜" * 40, "w " * 9_000, "ab" * 4_000]
    got = by_id(edit_sensitivity(docs(spark, texts)))
    for i, t in enumerate(texts):
        after = texts[i - 1]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        one, two, three = map(brute_fingerprint, (t, edit, after))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (one, two), i
        assert abs(got[i]["near_edited"] - brute_likeness(one, two)) < 1e-12 and abs(got[i]["near_next"] - brute_likeness(one, three)) < 1e-12


def test_texts_without_blanks_keep_some_likeness(spark):
    random.seed(4)
    text = "".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    got = by_id(fingerprints(docs(spark, [text, text[:300] + "字" + text[301:], text[::-1]])))
    f = [set(got[i]["fingerprint"].split()) for i in range(3)]
    assert len(f[0] & f[1]) > 40 and not f[0] & f[2]
