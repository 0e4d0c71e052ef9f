from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing
from tests.llm.helpers import docs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_pfair_windows_and_deviation(shares):
    shares = {f"s{i:02}": n for i, n in enumerate(shares)}
    period, done = sum(shares.values()), Counter()
    plan = mixing.schedule(shares)
    assert [p[2] for p in plan] == list(range(period))
    for source, k, slot, release, deadline in plan:
        assert k == done[source] and release <= slot < deadline
        assert (release, deadline) == (k * period // shares[source], -(-(k + 1) * period // shares[source]))
        done[source] += 1
        assert all(abs(done[s] - Fraction((slot + 1) * n, period)) < 1 for s, n in shares.items())
    assert done == Counter(shares)


def test_slots_add_up():
    got = mixing.slots_of({"a": 5, "b": 1e-9, "c": 2.5}, 100)
    assert sum(got.values()) == 100 and min(got.values()) >= 1 and got["a"] > got["c"] > got["b"]


def test_mix_equals_brute_force(spark):
    sources = ["a"] * 200 + ["b"] * 60 + [None] * 30 + [""] * 10
    d = docs(spark, ["t"] * 300, sources=sources)
    got = [r.asDict() for r in mixing.mix(d, block_docs=4, period=50).collect()]
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    key = lambda s: "" if s is None else f"={s}"
    shares = mixing.slots_of({key(s): n**0.5 for s, n in Counter(sources).items()}, 50)
    slot = {(s, k): (t, r, e) for s, k, t, r, e in mixing.schedule(shares)}
    for s in set(sources):
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["source_rank"])
        assert [r["source_rank"] for r in mine] == list(range(sources.count(s)))
        for r in mine:
            block = r["source_rank"] // 4
            past = block // shares[key(s)] * 50
            assert (r["block"], (r["slot"], r["release"], r["deadline"])) == (block, tuple(past + x for x in slot[key(s), block % shares[key(s)]]))


def test_rows_come_in_order_and_whole(spark):
    d = docs(spark, [str(i) for i in range(100)] + [None, ""], sources=["a", "b"] * 51).selectExpr("*", "1 as slot", "2 as rank")
    rows = mixing.mixed_rows(d, weights={"a": 3, "b": 1}, block_docs=2, period=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(102)) and rows[0].asDict().keys() == set(d.columns)
    head = Counter(r["source"] for r in rows[:32])
    assert abs(head["a"] - 24) <= 2
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_rows(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-3, 10), st.integers(0, 60)), min_size=1, max_size=12))
def test_exact_weights_keep_within_a_block(given):
    weights = {f"s{i:02}": w for i, (w, _) in enumerate(given)}
    blocks = {f"s{i:02}": n for i, (_, n) in enumerate(given)}
    total, done, last = sum(Fraction(w) for w in weights.values()), Counter(), -1
    for source, k, slot, release, deadline in mixing.schedule_all(weights, blocks):
        share = Fraction(weights[source]) / total
        assert k == done[source] and last < slot and release <= slot < deadline and release == k // share
        last, done[source] = slot, k + 1
        assert all(done[s] == n or abs(done[s] - (slot + 1) * Fraction(weights[s]) / total) < 1 for s, n in blocks.items())
    assert done == Counter({s: n for s, n in blocks.items() if n})


def test_deviation_does_not_grow_over_many_periods(spark):
    # Rounded to a period of 1000 slots, the hot source fell behind by a block every few periods.
    counts = {"s00": 9_500, **{f"s{i:02}": 1_000 for i in range(1, 20)}}
    d = docs(spark, [None] * sum(counts.values()), sources=[s for s, n in counts.items() for _ in range(n)])
    blocks = sorted((r["slot"], r["source"]) for r in mixing.mix(d, block_docs=1).collect())
    total, done = sum(n**0.5 for n in counts.values()), Counter()
    for slot, source in blocks:
        done[source] += 1
        assert all(done[s] == n or abs(done[s] - (slot + 1) * n**0.5 / total) < 1 + 1e-6 for s, n in (("s00", counts["s00"]), (source, counts[source])))
    assert done == Counter(counts)


def test_weights_down_to_a_millionth_over_200_sources():
    weights = {"s000": 1.0, **{f"s{i:03}": 10.0 ** -(1 + i % 6) for i in range(1, 200)}}
    total, done = sum(Fraction(w) for w in weights.values()), Counter()
    for n, (source, k, slot, *_) in enumerate(mixing.schedule_all(weights, {s: 100_000 if s == "s000" else 50 for s in weights})):
        done[source] = k + 1
        assert all(done[s] == 50 or abs(done[s] - (slot + 1) * Fraction(weights[s]) / total) < 1 for s in ("s000", source, f"s{slot % 199 + 1:03}"))
        if n == 5_000:
            break


def test_blocks_grow_where_there_would_be_too_many(spark):
    got = mixing.mix(docs(spark, ["t"] * 1_000, sources=["a"] * 900 + ["b"] * 100), block_docs=1, max_blocks=100).collect()
    assert {r["block"] for r in got if r["source"] == "a"} == set(range(90)) and {r["source_rank"] // 10 for r in got} == set(range(90))
    assert all(r["block"] == r["source_rank"] // 10 for r in got) and len(got) == 1_000


def test_repeated_and_null_ids_and_ties(spark):
    d = docs(spark, ["t"] * 60, sources=["a", "b", None] * 20).selectExpr("if(doc_id % 2 = 0, null, 7) as doc_id", "source", "1 as source_rank", "2 as _row")
    got = mixing.mix(d, weights={"a": 1, "b": 1, None: 1}, block_docs=2).collect()
    assert len(got) == 60 and Counter(r["doc_id"] for r in got) == {None: 30, 7: 30}
    for s in ("a", "b", None):
        assert sorted(r["source_rank"] for r in got if r["source"] == s) == list(range(20))
    # Equal weights are a tie in every slot: blocks of the three take turns.
    assert all(len({r["source"] for r in got if r["slot"] // 3 == k}) == 3 for k in range(10))
