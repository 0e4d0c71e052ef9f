"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs in the training documents are quantised to levels (level l: 2^(l-1) to 2^l - 1 times). The
filter holds each n-gram once a level, up to its own, so that probing level after level until one is missing reads the
level back, with one-sided errors only. A word's probability is its pair's share smoothed by its own:

    p(w | v) = L * c(vw) / c(v) + (1 - L) * p(w),    p(w) = (m(w) + 0.5) / (sum of m + 0.5 * (V + 1))

where c(vw) is the least count of the pair's level, c(v) the count of the word before (of documents, at a text's start): the exact
one of frequent words, else the largest of its level; m is the middle of a level; L is ``WEIGHT``, or 0 after a word that training
lacks. So the probabilities that follow a history add up to 1 at most, but for chance hits of the filter; a pair counts as its rarer word allows at most, which takes most of those
back. All pairs are held, those seen once too.

The filter has ``BITS_PER_ENTRY`` bits an entry, so it grows with the corpus. Its blocks are built where their entries meet. Up
to ``MAX_BROADCAST`` bytes it is broadcast. A larger one stays in its table: the distinct n-grams of some megabytes of texts are
sent to their blocks, probed there, and their levels come back to the texts by a join, to the same scores.

The base score needs exact counts. Words of up to ``HEAD_CHARS`` bytes that are so frequent that at most ``HEAD_WORDS`` are
as frequent are broadcast with their counts; all other words go with their document's key through a join.

Edge cases: a null text counts as empty, which is one end token; texts of any length are read whole. Rows that repeat a doc_id
with its text get equal rows. A row with a null doc_id is scored but not learned from. Without training documents all counts
are 0 and both scores are sums of log10 1 = 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import groups, mixed, words_of
from millrace.llm.store import Tables, materialise, partitions
from millrace.llm.text import SPACE, ascii_lower, text_or_empty

WEIGHT = 0.3
BITS_PER_ENTRY, PROBES = 12, 4
#: Bits of a block, in which all probes of an n-gram stay.
BLOCK = 1 << 19
MAX_BROADCAST = 256 << 20
#: Where the filter isn't broadcast: blocks that a task holds at once, and bytes of the texts that ask together.
SLICE_BLOCKS, GROUP_BYTES = 64, 8 << 20
HEAD_WORDS, HEAD_CHARS = 1 << 17, 64
#: Entries that are set in the filter's blocks at once.
_ENTER_AT = 1 << 18
_U = np.uint64
_A = _U(0xD6E8FEB86659FD93)
#: Hashes of the end token and of what stands before a text's first token.
_END, _BEGIN = mixed(np.array([11, 12], _U))


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it."""
    before = np.concatenate(([_BEGIN], words[:-1]))
    before[first] = _BEGIN
    return mixed(before * _A + words)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Token hashes of some texts, each text's end token last; where texts begin (and the end); the words' places."""
    hashes, begins, joined, starts, ends = words_of(texts)
    tokens = np.insert(hashes, begins[1:], _END)
    return tokens, begins + np.arange(len(begins)), (joined, starts, ends)


def _place(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    """Bit of a key's block."""
    return (mixed(keys + _U((level * 16 + probe) * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(BLOCK)).astype(np.int64)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> _U(32)) % _U(blocks)).astype(np.int64)


def level_middle(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 of none."""
    return np.where(level > 0, (2.0 ** (level - 1.0) + 2.0**level - 1) / 2, 0.0)


class Slice(NamedTuple):
    """Blocks ``first`` and on of a filter of ``blocks``, as bytes."""

    blocks: int
    first: int
    bits: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, by probing one level after the other; 0 for keys of other slices."""
        found = np.zeros(len(keys), np.uint8)
        block = _block(keys, self.blocks) - self.first
        at = np.flatnonzero((block >= 0) & (block < len(self.bits) // (BLOCK // 8)))
        level = 1
        while len(at):
            for probe in range(PROBES):
                bit = block[at] * BLOCK + _place(keys[at], level, probe)
                at = at[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            found[at] = level
            level += 1
        return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            yield (*row[:-1], row[-1].encode("utf-8", "surrogatepass"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """h, c: hashed word pairs of the texts and their counts. A task sums them by the megabyte before the shuffle does."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(_texts(batches), 8 << 20):
            tokens, begins, _ = _tokens([t for (t,) in group])
            keys, counts = np.unique(_pairs(tokens, begins[:-1]), return_counts=True)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], schema=schema)

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def word_hashes(counts: DataFrame) -> DataFrame:
    """h, c of a table of tokens (the empty string is the end token) and counts."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hash_tokens(batch.column(0).to_pylist()).view(np.int64)), batch.column(1)], schema=schema)

    return counts.select("token", "c").mapInArrow(run, "h long, c long")


def _hash_tokens(tokens: list[str]) -> np.ndarray:
    hashes, begins, *_ = words_of([t.encode("utf-8", "surrogatepass") for t in tokens])
    out = np.full(len(tokens), _END, _U)
    out[np.diff(begins) > 0] = hashes
    return out


def build(entries: DataFrame, blocks: int) -> DataFrame:
    """block, bits: the filter's blocks from (h, level), each made in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def enter() -> None:
            keys, levels = (np.concatenate(x) for x in zip(*held, strict=True))
            block = _block(keys, blocks)
            order = np.argsort(block, kind="stable")
            begins = np.flatnonzero(np.diff(block[order], prepend=-1))
            for mine in np.split(order, begins[1:]):
                keys_b, own, bits = keys[mine], levels[mine], np.zeros(BLOCK, bool)
                for level in range(1, int(own.max()) + 1):
                    keys_b, own = keys_b[own >= level], own[own >= level]
                    for probe in range(PROBES):
                        bits[_place(keys_b, level, probe)] = True
                b = int(block[mine[0]])
                made[b] = made.get(b, 0) | np.packbits(bits, bitorder="little")
            held.clear()

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) >= _ENTER_AT:
                enter()
        if held:
            enter()
        for b in sorted(made):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([made[b].tobytes()], pa.binary())], names=["block", "bits"])

    block = F.shiftrightunsigned("h", 32) % blocks
    parts = max(1, min(blocks, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return entries.repartition(parts, block).mapInArrow(run, "block long, bits binary")


class Score(NamedTuple):
    """What a worker needs: exact counts of frequent words (hashes sorted), corpus totals."""

    head: np.ndarray
    counts: np.ndarray
    denominator: float
    model_total: float
    documents: int


_SCORED = "doc_id long, text_1 long, text_2 long, n_tokens long, known long, base double, score double, tail array<struct<token:string,n:long>>"
_TAIL = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("text_1", pa.int64()), ("text_2", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", _TAIL)])


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins[:-1])


def _names(tokens: np.ndarray, begins: np.ndarray) -> list[list[int]]:
    """Two numbers that name each text by its tokens."""
    sums = [np.array([x.sum(dtype=_U), (mixed(x) * np.arange(1, len(x) + 1, dtype=_U)).sum(dtype=_U)]).view(np.int64) for x in np.split(tokens, begins[1:-1])]
    return [[int(n[0]) for n in sums], [int(n[1]) for n in sums]]


def _score_group(group: list[tuple], levels: Callable[[np.ndarray], np.ndarray], data: Score) -> pa.RecordBatch:
    """``levels``: the levels of distinct n-grams."""
    texts = [g[-1] for g in group]
    tokens, begins, (joined, starts, ends) = _tokens(texts)
    own, back = np.unique(tokens, return_inverse=True)
    pairs, pairs_back = np.unique(_pairs(tokens, begins[:-1]), return_inverse=True)
    of_words, of_pairs = levels(own), levels(pairs)
    at = np.minimum(np.searchsorted(data.head, own), max(len(data.head) - 1, 0))
    hit = data.head[at] == own if len(data.head) else np.zeros(len(own), bool)
    count = np.where(hit, data.counts[at] if len(data.head) else 0, 0)
    history = np.where(hit, count, 2.0**of_words - 1)
    log = np.log10(probabilities(of_words[back], of_pairs[pairs_back], begins[:-1], history[back], data.documents, data.model_total))
    base = np.where(hit, np.log10((count + 0.5) / data.denominator), 0)[back]
    known = (hit & (count > 0))[back]
    tail = _tails(~hit[back], begins, back, joined, starts, ends)
    columns = [[g[0] for g in group], *_names(tokens, begins), np.diff(begins), _sums(known.astype(np.int64), begins), _sums(base, begins), _sums(log, begins), tail]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED_ARROW, strict=True)], schema=_SCORED_ARROW)


def _tails(out: np.ndarray, begins: np.ndarray, kinds: np.ndarray, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """The words of each text that the head lacks, with their counts in it."""
    tails: list[list[dict]] = []
    for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
        mine = a + np.flatnonzero(out[a:b])
        _, first, n = np.unique(kinds[mine], return_index=True, return_counts=True)
        # Word i of text k is token i + k; a text's last token is its end.
        tails.append([{"token": joined[starts[i - k] : ends[i - k]].lower().decode("utf-8", "surrogatepass") if i < b - 1 else "", "n": int(c)} for i, c in zip(mine[first], n, strict=True)])
    return tails


def probabilities(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, history: np.ndarray, documents: int, total: float) -> np.ndarray:
    """p(w | v) of tokens in a row, from the levels of the words and of the pairs they end. ``history``: a count of each word that
    isn't below the true one; ``first``: where texts begin."""
    before, seen = np.empty(len(words), words.dtype), np.empty(len(words))
    before[1:], seen[1:] = words[:-1], history[:-1]
    before[first], seen[first] = int(documents).bit_length(), documents
    capped = np.minimum(pairs, np.minimum(before, words)).astype(np.float64)
    alone = (level_middle(words.astype(np.float64)) + 0.5) / total
    together = np.minimum(np.where(capped > 0, 2.0 ** (capped - 1), 0.0), seen)
    held = np.where(seen > 0, WEIGHT, 0.0)
    return held * together / np.maximum(seen, 1) + (1 - held) * alone


class Model(NamedTuple):
    """Tables of a trained model: counts (token, c) and filter blocks (block, bits), with corpus totals."""

    counts: DataFrame
    filter: DataFrame
    blocks: int
    tokens: int
    distinct: int
    level_total: float
    documents: int


def tokens_of(text: Column) -> Column:
    """All tokens of a text; the end token is the empty string."""
    return F.array_append(F.array_remove(F.split(ascii_lower(text), f"[{SPACE}]+"), ""), F.lit(""))


def train(texts: DataFrame, tables: Tables) -> Model:
    """A model of a table with the one column ``text`` (not null)."""
    counts = tables.write(texts.select(F.explode(tokens_of(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("c")), "counts")
    level = (F.floor(F.log2("c")) + 1).cast("int")
    entries = tables.write(word_hashes(counts).unionAll(pair_counts(texts)).select("h", level.alias("level")), "entries", "snappy")
    # The shuffle files of the counts go before the filter's are written.
    tables.drop()
    size = entries.agg(F.sum("level").alias("n")).first()["n"] or 0
    blocks = max(1, -(-size * BITS_PER_ENTRY // BLOCK))
    middles = F.sum((F.pow(2.0, level - 1) + F.pow(2.0, level) - 1) / 2)
    # Each document has one end.
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), middles.alias("m"), F.max(F.when(F.col("token") == "", F.col("c"))).alias("d")).first()
    made = tables.write(build(entries, blocks), "filter", "snappy")
    tables.drop(entries)
    return Model(counts, made, blocks, total["n"] or 0, total["v"], total["m"] or 0.0, total["d"] or 0)


def head_of(counts: DataFrame, words: int = HEAD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent tokens: all those above a count that at most ``words`` reach. A
    histogram of counts by eighths of a power of two (a few hundred rows) finds it."""
    short = counts.where(F.octet_length("token") <= HEAD_CHARS)
    step = F.floor(F.log2("c") * 8)
    kept, least = 0, None
    for r in sorted(short.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        kept += r["count"]
        if kept > words:
            break
        least = r["s"]
    if least is None:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    rows = short.where(step >= least).select("token", "c").toArrow()
    hashes, c = _hash_tokens(rows.column(0).to_pylist()), rows.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], c[order]


def _whole(model: Model) -> Slice:
    """The filter, read to the driver block by block."""
    bits = np.zeros(model.blocks * (BLOCK // 8), np.uint8)
    for r in model.filter.toLocalIterator():
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return Slice(model.blocks, 0, bits)


def score(docs: DataFrame, model: Model, tables: Tables, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row a document."""
    spark = docs.sparkSession
    denominator = model.tokens + 0.5 * (model.distinct + 1)
    data = spark.sparkContext.broadcast(Score(*head_of(model.counts, head_words), denominator, model.level_total + 0.5 * (model.distinct + 1), model.documents))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    if model.blocks * (BLOCK // 8) <= max_broadcast:
        part = spark.sparkContext.broadcast(_whole(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups(_texts(batches)):
                yield _score_group(group, part.value.levels, data.value)

        scored = tables.write(rows.mapInArrow(run, _SCORED), "scored")
        part.unpersist()
    else:
        scored = _by_joins(rows, model, tables, lambda group, levels: _score_group(group, levels, data.value))
    data.unpersist()
    key = ["doc_id", "text_1", "text_2"]
    tails = scored.select(*key, F.size("tail").alias("of"), F.explode("tail").alias("t")).select(*key, "of", "t.token", "t.n")
    counted = tails.join(model.counts.withColumnRenamed("token", "token_c"), F.col("token") == F.col("token_c"), "left")
    # Rows that repeat a document repeat its words here; what they add up to is divided by the number of the rows.
    copies = F.count("*") / F.first("of")
    rest = counted.groupBy(*key).agg(
        (F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / denominator)) / copies).alias("base_t"), (F.sum(F.when(F.col("c") > 0, F.col("n"))) / copies).cast("long").alias("known_t"),
    ).select(*[F.col(k).alias(f"{k}_t") for k in key], "base_t", "known_t")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_t")) & (F.col("text_1") == F.col("text_1_t")) & (F.col("text_2") == F.col("text_2_t"))
    none = F.lit(0)
    return scored.join(rest, same, "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("known_t", none)).alias("n_known"), (F.col("base") + F.coalesce("base_t", none)).alias("base_score"), "score"
    )


def _keys(texts: list[bytes]) -> np.ndarray:
    """The distinct n-grams of some texts, sorted."""
    found = []
    for group in groups((t,) for t in texts):
        tokens, begins, _ = _tokens([t for (t,) in group])
        found += [np.unique(tokens), np.unique(_pairs(tokens, begins[:-1]))]
    return np.unique(np.concatenate(found))


def _slices(keys: np.ndarray, blocks: int, many: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices, of ``many`` blocks each, of the filter that keys are in, with the places of those keys."""
    of = _block(keys, blocks) // many
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        yield int(of[at[0]]), at


def _by_joins(rows: DataFrame, model: Model, tables: Tables, scorer: Callable[[list[tuple], Callable[[np.ndarray], np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """What ``scorer`` makes of groups of ``rows`` (doc_id, text), with the levels that the filter's blocks have of their n-grams.

    Texts are gathered to some megabytes, compressed and written once. A group asks for each of its distinct n-grams once, sorted and
    without an address of its own: one row has all keys for a slice of the filter, the answer is as many levels in the same
    order, and the group sorts its n-grams again to read them. A slice's rows pass its bits one after the other, so no task
    holds more than the slice and some of the rows, however often an n-gram is asked for.
    """
    blocks, width, many, size = model.blocks, BLOCK // 8, SLICE_BLOCKS, GROUP_BYTES
    gathered_schema = pa.schema([("g", pa.string()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary())])
    asked_schema = pa.schema([("slice", pa.int64()), ("g", pa.string()), ("block", pa.int64()), ("data", pa.binary())])
    found_schema = pa.schema([("slice", pa.int64()), ("g", pa.string()), ("levels", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(_texts(batches), size):
            texts = [t for _, t in group]
            row = [uuid.uuid4().hex], [[i for i, _ in group]], [[len(t) for t in texts]], [pa.compress(b"".join(texts), "zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, gathered_schema, strict=True)], schema=gathered_schema)

    def texts_of(lengths: list[int], packed: bytes) -> list[bytes]:
        ends = np.cumsum(lengths, dtype=np.int64).tolist()
        raw = pa.decompress(packed, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        return [raw[e - n : e] for e, n in zip(ends, lengths, strict=True)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, lengths, packed in zip(*(batch.column(n) for n in ("g", "lengths", "texts")), strict=True):
                keys = _keys(texts_of(lengths.as_py(), packed.as_py()))
                # By bytes of equal place: the highest of sorted keys are alike, which makes them short in the shuffle.
                asked = [(k, g.as_py(), -1, keys[at].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()) for k, at in _slices(keys, blocks, many)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*asked, strict=True), asked_schema, strict=True)], schema=asked_schema)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = -1, np.zeros(0, np.uint8)
        for batch in batches:
            found = []
            for k, g, block, data in zip(*batch.columns, strict=True):
                k, block, data = k.as_py(), block.as_py(), np.frombuffer(data.as_py(), np.uint8)
                if k != held:
                    held, now = k, np.zeros(many * width, np.uint8)
                if block >= 0:
                    now[(block - k * many) * width :][:width] = data
                else:
                    keys = np.ascontiguousarray(data.reshape(8, -1).T).view(">u8").ravel().astype(_U)
                    found.append((k, g.as_py(), Slice(blocks, k * many, now).levels(keys).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), found_schema, strict=True)], schema=found_schema)

    def score_group(texts: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = texts.to_pylist()
        raw = texts_of(row["lengths"], row["texts"])
        keys = _keys(raw)
        levels, answers = np.zeros(len(keys), np.uint8), dict(zip(found["slice"].to_pylist(), found["levels"].to_pylist(), strict=True))
        for k, at in _slices(keys, blocks, many):
            levels[at] = np.frombuffer(answers[k], np.uint8)
        return pa.Table.from_batches([scorer(group, lambda asked: levels[np.searchsorted(keys, asked)]) for group in groups(zip(row["ids"], raw, strict=True))])

    gathered = tables.write(rows.mapInArrow(gather, "g string, ids array<long>, lengths array<long>, texts binary"), "gathered", "snappy")
    bits = model.filter.select(F.floor(F.col("block") / many).cast("long").alias("slice"), F.lit("").alias("g"), "block", F.col("bits").alias("data"))
    asked = bits.unionAll(gathered.mapInArrow(ask, "slice long, g string, block long, data binary"))
    # The filter's rows, without a group, come before the keys.
    met = asked.repartition(partitions(rows.sparkSession), "slice").sortWithinPartitions("slice", "g")
    found = tables.write(met.mapInArrow(probe, "slice long, g string, levels binary"), "levels")
    # The keys' shuffle files go before the texts are dealt out.
    tables.drop()
    scored = tables.write(gathered.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(score_group, _SCORED), "scored")
    tables.drop(gathered, found)
    return scored


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``score`` with a model of the rows that ``learn`` holds for; with train_tokens."""
    with Tables(docs.sparkSession) as tables:
        model = train(docs.where(learn & F.col(id_col).isNotNull()).select(text_or_empty(F.col(text_col)).alias("text")), tables)
        scored = score(docs, model, tables, id_col, text_col, **options).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
        return materialise(scored, "scores")
