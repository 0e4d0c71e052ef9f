"""Near-duplicate documents by b-bit MinHash, with links confirmed on whole shingle sets.

A document's set is its distinct shingles of ``words`` words. Documents with equal sets form a class, whose least id stands for
it. Each class has ``BANDS * ROWS`` minima under different hash functions. Bands of full minima make candidates (a pair at
the threshold shares none with probability (1 - 0.8^4)^24, some 3 in a million); the low ``BITS`` bits of the minima, packed, give
a similarity estimate by bit counts, corrected for chance collisions, and a candidate more than six standard deviations below
the threshold goes. The rest is confirmed on the whole sets. Shingles are 64-bit hashes and a class is named by 128 bits of
its set: two shingles of a pair of texts agree by chance once in 2^64, two sets once in 2^128.

Classes that share a band are not all paired. The least class of a band's group is compared with the others and leaves the
group; groups of one component need nothing more. After ``STAR_ROUNDS`` of these, what is left of small groups is paired.
Large groups are told apart by what each text has more or less than a pivot (see ``_Clusters``), which is exact: no pair that
can be alike enough is lost, and texts are never paired by what all of a group share.

Edge cases: a null text counts as empty; a text without words has an empty set, links with nothing and is its own component;
fewer words than a shingle make one shingle; texts of any length are read whole. Rows that repeat a doc_id with its text are judged
alike, each kept or not; one doc_id must not stand for several texts. A null doc_id links with nothing, has a null component and
is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import forget
from millrace.llm.components import components
from millrace.llm.hashing import groups, mixed, words_of
from millrace.llm.joins import keyed
from millrace.llm.store import Tables, materialise
from millrace.llm.text import text_or_empty

BANDS, ROWS, BITS = 24, 4, 4
_HASHES = BANDS * ROWS
_PER_LONG = 64 // BITS
#: Rounds of comparing with a group's least class, and the size up to which what is left of a group is paired.
STAR_ROUNDS, SMALL_GROUP = 2, 16
_U, _U32 = np.uint64, np.uint32
_A = _U(0xD6E8FEB86659FD93)


def _sets(hashes: np.ndarray, begins: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in zip(begins, begins[1:], strict=False):
        n = min(words, b - a)
        if not n:
            yield np.zeros(0, _U)
            continue
        made = np.full(b - a - n + 1, n, _U)
        for j in range(n):
            made = made * _A + hashes[a + j : b - n + 1 + j]
        yield np.unique(mixed(made))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * _HASHES + 1, dtype=_U))
    return (seeds[:_HASHES] >> _U(32)).astype(_U32) | _U32(1), (seeds[_HASHES:] >> _U(32)).astype(_U32)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(_HASHES, 0xFFFFFFFF, _U32)
    short = (shingles >> _U(32)).astype(_U32)
    for at in range(0, len(short), 2048):
        h = short[None, at : at + 2048] * a[:, None] + b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def _packed(minima: np.ndarray) -> list[int]:
    low = (mixed(minima.astype(_U)) & _U((1 << BITS) - 1)).reshape(-1, _PER_LONG) << (np.arange(_PER_LONG, dtype=_U) * _U(BITS))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64).tolist()


def _keys(minima: np.ndarray) -> list[int]:
    rows = minima.astype(_U).reshape(BANDS, ROWS)
    made = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(ROWS):
        made = mixed(made * _A + rows[:, j])
    return made.view(np.int64).tolist()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield i, t.encode("utf-8", "surrogatepass")


_SIGNED = "doc_id long, n_shingles long, set_1 long, set_2 long, signature array<long>, bands array<long>"
_SIGNED_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_shingles", "set_1", "set_2")] + [(n, pa.list_(pa.int64())) for n in ("signature", "bands")])
_SET_ARROW = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, set_1 and set_2 (128 bits that name the set), signature (packed low bits), bands (keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        a, b = _functions()
        for group in groups(_texts(batches)):
            hashes, begins, *_ = words_of([t for _, t in group])
            rows = []
            for (i, _), s in zip(group, _sets(hashes, begins, words), strict=True):
                name = np.array([s.sum(dtype=_U), mixed(s ^ _A).sum(dtype=_U)], _U).view(np.int64).tolist()
                m = _minima(s, a, b) if len(s) else None
                rows.append((i, len(s), *name, _packed(m) if len(s) else [], _keys(m) if len(s) else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIGNED_ARROW, strict=True)], schema=_SIGNED_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, _SIGNED)


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """id, shingles (distinct 64-bit hashes) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for group in groups(_texts(batches)):
            hashes, begins, *_ = words_of([t for _, t in group])
            made = [s.view(np.int64) for s in _sets(hashes, begins, words)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.array(made, pa.list_(pa.int64()))], schema=_SET_ARROW)

    return rows.mapInArrow(run, "id long, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal low bits, less what chance makes equal."""
    ones = sum(1 << (BITS * i) for i in range(_PER_LONG))
    ones -= 1 << 64 if ones >> 63 else 0

    def unequal(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    apart = sum((unequal(i) for i in range(1, _HASHES // _PER_LONG)), unequal(0))
    chance = 2.0**-BITS
    return ((1 - apart / _HASHES) - chance) / (1 - chance)


class _Linker:
    """Confirms candidate pairs of classes, each once."""

    def __init__(self, classes: DataFrame, sets: DataFrame, threshold: Fraction):
        self.classes, self.sets, self.threshold = classes, sets, threshold

    def links(self, pairs: DataFrame) -> DataFrame:
        """a, b: the pairs (a < b) whose sets are alike enough."""
        up, down = self.threshold.numerator, self.threshold.denominator
        of = lambda x: self.classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
        rough = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
        spread = (float(self.threshold) * (1 - float(self.threshold)) / _HASHES) ** 0.5
        rough = rough.where((F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up) & (estimate(F.col("s_a"), F.col("s_b")) >= float(self.threshold) - 6 * spread)).select("a", "b")
        both = rough.join(self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

        shared = F.size(F.array_intersect("x", "y"))
        return both.where(down * shared >= up * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _open(rows: DataFrame) -> DataFrame:
    """key, id, component of the groups that hold more than one component, with the least id (``first``), its component
    (``head``) and the ``size`` of the group."""
    lead = F.min(F.struct("id", "component"))
    many = rows.groupBy("key").agg(lead.alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return keyed(rows.select("key", "id", "component"), many.select("key", F.col("lead.id").alias("first"), F.col("lead.component").alias("head"), "size"), ["key"])


def _pairs_within(rows: DataFrame) -> DataFrame:
    left = rows.select("key", F.col("id").alias("a"), F.col("component").alias("c_a"))
    right = rows.select("key", F.col("id").alias("b"), F.col("component").alias("c_b"))
    return left.join(right, "key").where("a < b and c_a <> c_b").select("a", "b")


class _Clusters:
    """Links within large groups, told by differences from a pivot.

    Groups that share texts make a cluster; its smallest set is the pivot P. Let D(x) be the symmetric difference of x and P, and
    f(x) = |D(x)| (q + p) - |x| (q - p) for the threshold p / q. Sets a and b are alike enough where (q + p) |a ^ b| is
    at most (q - p) (|a| + |b|), and a ^ b = D(a) ^ D(b). So

    * pairs with f(a) + f(b) <= 0 are alike whatever the differences share. Each such text is also alike to the text with the
      least f, which takes one aggregate instead of pairs (``sure``);
    * all others must share ceil((f(a) + f(b)) / 2 (q + p)) elements of their differences, one at least. A prefix filter over the
      rarest elements, with the places of both texts checked, finds them (``pairs``). The cluster's largest component is
      joined with the texts outside it, never with itself.
    """

    def __init__(self, rows: DataFrame, sets: DataFrame, threshold: Fraction, tables: Tables):
        """``rows``: id, component, first (another id of the group)."""
        p, q = threshold.numerator, threshold.denominator
        self.p, self.q = p, q
        linked = components(rows.select("id", "first"), "id", "first", tables).select(F.col("id").alias("id_c"), F.col("component").alias("cluster"))
        members = rows.select("id", "component").distinct().join(linked, F.col("id") == F.col("id_c")).drop("id_c")
        own = tables.write(members.join(sets, "id"), "own", "snappy")
        pivots = own.groupBy("cluster").agg(F.min(F.struct(F.size("shingles").alias("n"), "id")).alias("x")).select("cluster", F.col("x.id").alias("pivot"))
        bases = pivots.join(sets.withColumnRenamed("shingles", "base"), F.col("pivot") == F.col("id")).select("cluster", "base")
        d = F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles"))
        apart = keyed(own, bases, ["cluster"]).select("id", "component", "cluster", F.size("shingles").alias("n"), d.alias("d"))
        apart = tables.write(apart.withColumn("size", F.size("d")).withColumn("f", F.col("size") * (q + p) - F.col("n") * (q - p)), "apart", "snappy")
        tables.drop(own)
        least = apart.groupBy("cluster").agg(F.min(F.struct("f", "id", "component")).alias("m"))
        self.rows = keyed(apart, least.select("cluster", F.col("m.f").alias("f_m"), F.col("m.id").alias("id_m"), F.col("m.component").alias("component_m")), ["cluster"])
        self.rows = self.rows.withColumn("close", F.col("f") + F.col("f_m") <= 0)

    def sure(self) -> DataFrame:
        """a, b: links with the text of the least f."""
        return self.rows.where("close and id <> id_m").select(F.least("id", "id_m").alias("a"), F.greatest("id", "id_m").alias("b"))

    def pairs(self, tables: Tables) -> DataFrame:
        """a, b: candidates of different components that ``sure`` doesn't link."""
        p, q = self.p, self.q
        near = self.rows.withColumn("component", F.when(F.col("close"), F.col("component_m")).otherwise(F.col("component")))
        sizes = near.groupBy("cluster", "component").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("cluster").agg(F.max(F.struct("m", "component")).alias("l")).select("cluster", F.col("l.component").alias("largest"))
        each = keyed(near, largest, ["cluster"]).select("id", "component", "cluster", "n", "size", (F.col("component") == F.col("largest")).alias("inside"), F.explode("d").alias("shingle"))
        counted = keyed(each, each.groupBy("cluster", "shingle").agg(F.count("*").alias("df")), ["cluster", "shingle"])
        rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle"))
        # A partner has up to n q / p elements, so a text misses at most n (q - p) / p of those of its difference.
        ranked = counted.where("df > 1").withColumn("rank", rank + F.col("size") - F.count("*").over(Window.partitionBy("id")))
        table = tables.write(ranked.where(F.col("rank") <= F.floor(F.col("n") * (q - p) / p) + 1).drop("df"), "differences")
        side = lambda x: table.select(*[F.col(c).alias(f"{c}_{x}") for c in table.columns])
        excess = (F.col("size_a") + F.col("size_b")) * (q + p) - (F.col("n_a") + F.col("n_b")) * (q - p)
        shared = F.ceil(excess / (2 * (q + p)))
        places = (F.col("rank_a") <= F.col("size_a") - shared + 1) & (F.col("rank_b") <= F.col("size_b") - shared + 1)
        alike = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
        once = F.col("inside_b") | (F.col("id_a") < F.col("id_b"))
        on = (F.col("cluster_a") == F.col("cluster_b")) & (F.col("shingle_a") == F.col("shingle_b")) & (F.col("component_a") != F.col("component_b")) & once & alike & places
        return side("a").where("not inside_a").join(side("b"), on).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _members(full: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep (the least doc_id with the same set) of documents with words."""
    return keyed(full.select("doc_id", "n_shingles", "set_1", "set_2"), full.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("rep")), ["set_1", "set_2"]).select("doc_id", "n_shingles", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, star_rounds: int = STAR_ROUNDS, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id it is linked to, itself included), kept."""
    with Tables(docs.sparkSession) as tables:
        return materialise(_judged(docs, id_col, text_col, words, Fraction(str(threshold)), star_rounds, small_group, tables), "near")


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, limit: Fraction, star_rounds: int, small_group: int, tables: Tables) -> DataFrame:
    rows = tables.write(signed(docs, id_col, text_col, words), "signed")
    full = rows.where("doc_id is not null and n_shingles > 0")
    members = tables.write(_members(full), "members")
    reps = full.join(members.select(F.col("rep").alias("id")).distinct(), F.col("doc_id") == F.col("id"))
    bands = reps.select("id", F.explode("bands").alias("key")).distinct()
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups_ = tables.write(keyed(bands, shared, ["key"]).select("key", "id"), "bands")
    candidates = groups_.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(F.col(text_col)).alias("text")).join(candidates, F.col("d") == F.col("id")).select("id", "text")
    sets = tables.write(shingle_sets(texts, words).dropDuplicates(["id"]), "sets", "snappy")
    classes = tables.write(full.join(candidates, F.col("doc_id") == F.col("id")).select("id", "n_shingles", "signature").dropDuplicates(["id"]), "classes")
    linker, found = _Linker(classes, sets, limit), None

    def merged(links: DataFrame) -> DataFrame:
        """The component table of the links so far and these."""
        known = links if found is None else links.unionAll(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        now = components(known, "a", "b", tables)
        if found is not None:
            tables.drop(found)
        return now

    left = groups_.withColumn("component", F.col("id"))
    open_ = tables.write(_open(left), "open")
    for _ in range(star_rounds):
        if open_.isEmpty():
            break
        found = merged(linker.links(open_.where("id <> first and component <> head").select(F.col("first").alias("a"), F.col("id").alias("b"))))
        rest = open_.where("id <> first").select("key", "id").join(found.withColumnRenamed("id", "id_f"), F.col("id") == F.col("id_f"), "left")
        then = tables.write(_open(rest.select("key", "id", F.coalesce("component", "id").alias("component"))), "open")
        tables.drop(open_)
        open_ = then
    if not open_.isEmpty():
        pairs = _pairs_within(open_.where(F.col("size") <= small_group))
        large = open_.where(F.col("size") > small_group).select("id", "component", "first")
        sure = None
        if not large.isEmpty():
            clusters = _Clusters(large, sets, limit, tables)
            pairs, sure = pairs.unionAll(clusters.pairs(tables)), clusters.sure()
        links = linker.links(pairs)
        found = merged(links if sure is None else links.unionAll(sure))
    return _result(rows, members, found)


def _result(rows: DataFrame, members: DataFrame, found: DataFrame | None) -> DataFrame:
    linked = members.withColumn("component", F.col("rep")) if found is None else members.join(found.withColumnRenamed("id", "rep_c"), F.col("rep") == F.col("rep_c"), "left")
    linked = linked.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Texts don't move: the ids that go are taken away."""
    judged = near_duplicates(docs, id_col, text_col, **options)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
