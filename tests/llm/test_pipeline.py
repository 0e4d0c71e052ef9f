import importlib.util
import random

import corpus_pipeline
from millrace.llm import histogram_packing
from millrace.llm.store import materialise
from tests.llm.helpers import docs
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_minhash_dedup import brute as near_brute
from tests.llm.test_packing import check_pack

SF = "/root/testdata/sf0.01"
WORDS = "stone river cloud house paper window garden light winter mountain letter music bread water forest".split()


def test_every_stage_equals_brute_force(spark):
    from millrace.llm.bpe import tokenizer_path
    from tokenizers import Tokenizer

    now = spark.read.parquet(f"{SF}/documents.parquet")
    now = now.unionByName(docs(spark, [None, "", "123 456", "Ωμέγα και άλφα " * 20], [None] * 4, [None] * 4, first=90_000))
    columns, texts = now.columns, {r["doc_id"]: r["text"] for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, now, SF), name)
        rows = {r["doc_id"]: r for r in out.collect()} if name != "packing" else {}
        if name == "language_id":
            assert set(texts) - set(rows) == {90_000, 90_001, 90_002, 90_003}
        if name == "exact_dedup":
            assert set(rows) == {i for i, r in exact_brute(texts).items() if r["kept"]}
        if name == "minhash_near_dedup":
            assert set(rows) == {i for i, r in near_brute(texts, 5).items() if r[2]}
        if name == "source_mixing":
            assert set(rows) == set(texts)
        if name == "packing":
            ids = {d: k for k, d in enumerate(sorted(texts))}
            packed = [{**r.asDict(), "doc_id": ids[r["doc_id"]]} for r in out.collect()]
            assert check_pack(packed, [texts[d] for d in sorted(texts)], Tokenizer.from_file(tokenizer_path())) < 0.02
            break
        assert out.columns == columns and len(rows) == out.count()
        now, texts = out, {i: r["text"] for i, r in rows.items()}


def test_the_entry_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert importlib.util.find_spec("millrace.llm") is not None


def test_the_mix_reaches_the_sequences(spark):
    # Shares by weight (square roots of 3600 and 400) are 3 to 1 until b runs dry, shares by count 9 to 1.
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(150, 350)))
    sources = ["a"] * 3_600 + ["b"] * 400
    rows = corpus_pipeline.packed(spark, docs(spark, [text() for _ in sources], sources=sources), SF).collect()
    assert len({r["doc_id"] for r in rows}) == 4_000
    first = {r["doc_id"] for r in rows if r["sequence_id"] < histogram_packing.WINDOW}
    b = sum(sources[i] == "b" for i in first)
    assert len(first) > 300 and abs(b / len(first) - 0.25) < 0.04


def test_an_empty_table_repeated_rows_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], docs(spark, []).schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(20)]
    d = docs(spark, [*texts, None, ""], sources=["a", None] * 11)
    odd = d.union(d).selectExpr("*", "1 as _row", "2 as _text", "3 as _p", "4 as id", "5 as slot", "6 as kept", "7 as score", "8 as rep")
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, SF), name)
        assert now.columns == odd.columns
    assert sorted(r["doc_id"] for r in now.collect()) == list(range(20))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(r["doc_id"] for r in rows if r["start"] == 0) == list(range(20))


def test_workers_that_packed_hold_no_vocabulary_in_other_stages(spark):
    import pyarrow as pa

    from millrace.llm import lang_id, minhash_dedup
    from millrace.llm.bpe import _ENCODERS, encoder, tokenizer_path

    def held(operator):
        encoder(tokenizer_path())
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c d e f"], "_text": ["a b c"]})
        operator(iter([batch]))
        return len(_ENCODERS)

    class Rows:
        """Runs what an operator would run in a worker."""

        def __getattr__(self, name):
            return lambda *a, **b: self

        def mapInArrow(self, run, *_):
            self.run = run
            return self

    rows = Rows()
    minhash_dedup.shingle_sets(rows, 5)
    assert held(lambda b: list(rows.run(b))) == 0
    d = docs(spark, ["a b c d e f"])
    for build in (lambda: minhash_dedup.signed(d, "doc_id", "text", 5), lambda: lang_id.identify(d, d["doc_id"] >= 0)):
        found, kept = [], type(d).mapInArrow
        type(d).mapInArrow = lambda self, run, *a, found=found, kept=kept, **b: found.append(run) or kept(self, run, *a, **b)
        try:
            build()
        finally:
            type(d).mapInArrow = kept
        assert held(lambda b, found=found: list(found[0](b))) == 0


def test_small_tables_of_the_driver_take_no_python_worker(spark):
    from millrace.llm import mixing

    totals = materialise(spark.range(3).selectExpr("id", "id as n"), "totals")
    for df in (mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")), histogram_packing._starts(totals, "id")):
        assert "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()
