import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bestfit_packing, histogram_packing
from millrace.llm.bpe import encoder, tokenizer_path
from tests.llm.helpers import SF, docs

ODD = ["", None, " ", "a", " a  b", "x\n y", "  lead", "tail  ", "don't  stop ", "<|endoftext|> a<|endoftext|>", "日本 語 ありがとう", "naïve CAFÉ ǅ ſ", "a b c", "tab\tand \n\nlines", "e" * 9000, "word " * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_cached_ids_equal_the_tokenizers(spark, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(encoder(tokenizer_path()).encode(t or ""), "<u4").tolist() == ids_of(tokenizer, t)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '<|>.\n\tÉß  日1²'sll")), max_size=40))
def test_cached_ids_of_any_text(text):
    from tokenizers import Tokenizer

    assert np.frombuffer(encoder(tokenizer_path()).encode(text), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def check_pack(rows, texts, tokenizer, size=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = np.array(ids_of(tokenizer, t), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / max(total, 1)


def test_histogram_packing(spark, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    rows = histogram_packing.pack(docs(spark, texts), tokenizer_path()).collect()
    assert check_pack(rows, texts, tokenizer) < 0.02
    assert histogram_packing.pack(docs(spark, []), tokenizer_path()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    seen, filled = defaultdict(int), defaultdict(set)
    for length, lo, hi, first, offset in histogram_packing.plan(histogram, 64):
        assert lo == seen[length]
        seen[length] = hi
        for s in range(first, first + hi - lo):
            span = set(range(offset, offset + length))
            assert not span & filled[s] and max(span) < 64
            filled[s] |= span
    assert dict(seen) == histogram
    assert all(v == set(range(len(v))) for v in filled.values())


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400).tolist()
    free, at = [], []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(100 - lengths[i])
    got = bestfit_packing.best_fit(lengths, 100)
    assert sorted(x for s in got for x in s) == list(range(400))
    assert sorted(100 - sum(lengths[i] for i in s) for s in got) == sorted(free)


def test_matrices_round_trip(spark, tokenizer, tmp_path):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect()]
    bestfit_packing.write_matrices(docs(spark, texts), str(tmp_path / "m"), tokenizer_path(), block_tokens=100_000)
    found = defaultdict(dict)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, pos = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == len(pos) == 2048 and r["cu_seqlens"][-1] == r["n_tokens"]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            found[d][s] = ids[a:b].tolist()
    for i, t in enumerate(texts):
        assert sum((found[i][s] for s in sorted(found[i])), []) == ids_of(tokenizer, t)
    assert bestfit_packing.matrices(docs(spark, []), tokenizer_path()).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark, tokenizer):
    texts = ["one two three", "word " * 5000, None, "one two three"]
    d = docs(spark, texts).selectExpr("if(doc_id = 0, null, if(doc_id = 3, 1, doc_id)) as doc_id", "text", "source", "1 as length", "2 as sequence_id", "3 as cuts", "4 as window")
    want = sorted([len(ids_of(tokenizer, t)) for t in texts] * 2)
    for rows in (histogram_packing.pack(d.union(d), tokenizer_path()).collect(), histogram_packing.pack_mixed(d.union(d), tokenizer_path()).collect()):
        assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want and sum(r["length"] for r in rows) == sum(want)
        spans = defaultdict(list)
        for r in rows:
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in spans.values():
            assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
    found = bestfit_packing.matrices(d.union(d), tokenizer_path(), block_tokens=3_000).collect()
    assert sum(r["n_tokens"] for r in found) == sum(want) and sum(r["doc_ids"].count(None) for r in found) == 2
    assert sum(n for r in found for n in np.diff(r["cu_seqlens"])) == sum(want)


def test_starts_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(histogram_packing, "_RUN", 8)
    totals = spark.range(0, 100, 3).selectExpr("id", "id % 7 + 1 as n")
    got = {r["key_s"]: r["before"] for r in histogram_packing._starts(totals, "id").collect()}
    assert got == {k: sum(j % 7 + 1 for j in range(0, k, 3)) for k in range(0, 100, 3)}
