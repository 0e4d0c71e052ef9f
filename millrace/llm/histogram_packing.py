"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenised once; a document longer than a sequence is cut into full sequences and a rest, and the rests of
every eighth document (by a hash of its id) are cut at powers of two: such small pieces fill the gaps of the others. Only the
histogram of piece lengths (at most ``size`` rows) reaches the driver. There, lengths are placed longest first, all pieces
of a length at once, into the emptiest pack that holds them; a pack stands for a run of sequences with one packing pattern.
The plan maps ranges of ranks within a length to sequences, and pieces get their ranks by counting: a hash spreads each
length over buckets, so a length that a third of the pieces have meets in no task.

``pack_mixed`` keeps to the order of ``mixing``: that order is cut into windows of ``WINDOW`` sequences' tokens, each window is
packed on its own, and its sequences are numbered by the places of their first pieces. A task sees one window at a time.

Edge cases: null and empty texts are one end id; texts of any length are cut losslessly; repeated rows are packed as often
as they stand there; a null doc_id is a document like others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.store import Tables, materialise, partitions, small
from millrace.llm.tokens import END_ID, WIDTH, document_ids

SIZE = 2048
#: One document in so many is cut small.
FILLER_EVERY = 8
#: Sequences that are packed together where an order is kept.
WINDOW = 128
#: Keys of a table of starts whose sums reach the driver as one.
_RUN = 1 << 16
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CUT = "doc_id long, source string, cuts array<struct<start:long,length:long,ids_crc32:long>>, doc_tokens long"
_FILLED = "window long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long"


def piece_lengths(total: int, size: int, small: bool) -> list[int]:
    """Full sequences and a rest; ``small`` cuts the rest at the powers of two that add up to it."""
    full, rest = divmod(total, size)
    tail = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if small else [rest] * (rest > 0)
    return [size] * full + tail


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for doc_id, ids in document_ids(batches, path, end_id):
            start, total = 0, len(ids) // WIDTH
            small = zlib.crc32(f"filler {doc_id}".encode()) % FILLER_EVERY == 0
            for n in piece_lengths(total, size, small):
                held.append((doc_id, start, n, zlib.crc32(ids[start * WIDTH : (start + n) * WIDTH]), total))
                start += n
            if len(held) >= 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a length with those ranks go to as many
    sequences in a row, at the offset.

    Packs are runs of sequences filled alike. A length's pieces go to the emptiest packs while they fit, then open packs.
    """
    packs: dict[int, list[tuple[int, int]]] = {}  # by tokens so far: (first sequence, how many)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fill = min((f for f in packs if f + length <= size), default=None)
            if fill is None:
                fill, opened = 0, -(-left // (size // length))
                packs[0] = [(sequences, opened)]
                sequences += opened
            first, many = packs[fill].pop()
            if not packs[fill]:
                del packs[fill]
            used = min(many, left)
            if many > used:
                packs.setdefault(fill, []).append((first + used, many - used))
            if fill + length < size:
                packs.setdefault(fill + length, []).append((first, used))
            out.append((length, rank, rank + used, first, fill))
            rank, left = rank + used, left - used
    return out


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """``found`` with ``rank``, 0 to n-1 within a length, by counting over hash buckets."""
    spread = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("length").alias("length_s"), F.col("bucket").alias("bucket_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    local = spread.withColumn("within", within)
    both = local.join(starts, (F.col("length") == F.col("length_s")) & (F.col("bucket") == F.col("bucket_s")))
    return both.select(*found.columns, (F.col("before") + F.col("within") - 1).alias("rank"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    found = materialise(pieces(docs, path, id_col, text_col, size, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``size`` rows
    rows = plan(histogram, size)
    buckets = max(64, sum(histogram.values()) // 20_000)
    # The plan has a row for each run of sequences that a length meets: it grows with ``size``, not with the documents.
    placed = small(spark, rows, pa.schema([(n, pa.int64()) for n in ("length_p", "lo", "hi", "first", "offset")]))
    on = (F.col("length") == F.col("length_p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    joined = ranked(found, buckets).join(F.broadcast(placed), on)
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def _cuts(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str, size: int, end_id: int) -> DataFrame:
    """doc_id, source, cuts, doc_tokens: one row a document, with its pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("cuts", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "ids_crc32")]))), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for (doc_id, ids), source in zip(document_ids(iter([batch]), path, end_id), batch.column(2).to_pylist(), strict=True):
                start, total, cuts = 0, len(ids) // WIDTH, []
                small = zlib.crc32(f"filler {doc_id}".encode()) % FILLER_EVERY == 0
                for n in piece_lengths(total, size, small):
                    cuts.append({"start": start, "length": n, "ids_crc32": zlib.crc32(ids[start * WIDTH : (start + n) * WIDTH])})
                    start += n
                held.append({"doc_id": doc_id, "source": source, "cuts": cuts, "doc_tokens": total})
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source")).mapInArrow(run, _CUT)


def _tokens_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens that stand before each piece in its partition."""
    before = 0
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        ends = before + np.cumsum(lengths)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - lengths, pa.int64())], names=[*batch.schema.names, "at"])
        before = int(ends[-1]) if len(ends) else before


def fill(lengths: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of a window. Pieces of a length are taken by place, sequences numbered by that of
    their first piece."""
    by = np.lexsort((at, lengths))
    kinds, begins, counts = np.unique(lengths[by], return_index=True, return_counts=True)
    begin = dict(zip(kinds.tolist(), begins.tolist(), strict=True))
    sequence, offsets = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    for length, lo, hi, first, offset in plan(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), size):
        rows = by[begin[length] + lo : begin[length] + hi]
        sequence[rows], offsets[rows] = first + np.arange(hi - lo), offset
    heads = np.flatnonzero(offsets == 0)
    heads = heads[np.argsort(at[heads])]
    number = np.empty(len(heads), np.int64)
    number[sequence[heads]] = np.arange(len(heads))
    return number[sequence], offsets


def _starts(totals: DataFrame, key: str) -> DataFrame:
    """key_s, before: what the keys (whole numbers, once each) before each add up to in ``n``. The driver sees one sum for every
    ``_RUN`` keys; within such a run a window adds up."""
    runs = totals.withColumn("run", F.floor(F.col(key) / _RUN).cast("long"))
    rows, before = [], 0
    for k, n in sorted(tuple(r) for r in runs.groupBy("run").agg(F.sum("n")).collect()):
        rows.append((k, before))
        before += n
    of_runs = small(totals.sparkSession, rows, pa.schema([("run_s", pa.int64()), ("before_run", pa.int64())]))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    summed = runs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(of_runs), F.col("run") == F.col("run_s"))
    return summed.select(F.col(key).alias("key_s"), (F.col("before_run") + F.col("inside")).alias("before"))


def pack_mixed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = SIZE, end_id: int = END_ID, window: int = WINDOW, **mix) -> DataFrame:
    """The columns of ``pack``; sequence ids follow the order of ``mixing.mix`` (with the options ``mix``), window by window."""
    with Tables(docs.sparkSession) as tables:
        cut = tables.write(_cuts(docs, path, id_col, text_col, source_col, size, end_id), "cuts")
        placed = mixing.mix(cut, keep=("cuts", "doc_tokens"), **mix).repartitionByRange(partitions(docs.sparkSession), "slot", "source_rank").sortWithinPartitions("slot", "source_rank")
        found = placed.select(F.spark_partition_id().alias("part"), "doc_id", F.explode("_row.cuts").alias("c"), F.col("_row.doc_tokens").alias("doc_tokens")).select("part", "doc_id", "c.*", "doc_tokens")
        found = tables.write(found.mapInArrow(_tokens_before, "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, at long"), "pieces")
        at = F.col("at") + F.col("before")
        found = found.join(_starts(found.groupBy("part").agg(F.sum("length").alias("n")), "part"), F.col("part") == F.col("key_s")).withColumn("at", at).drop("part", "key_s", "before")

        def run(table: pa.Table) -> pa.Table:
            number, offset = fill(table["length"].to_numpy(), table["at"].to_numpy(), size)
            return table.drop_columns(["at"]).append_column("number", pa.array(number)).append_column("offset", pa.array(offset))

        windows = found.select(F.floor(F.col("at") / (size * window)).cast("long").alias("window"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "at")
        filled = materialise(windows.groupBy("window").applyInArrow(run, _FILLED), "filled")
        joined = filled.join(_starts(filled.groupBy("window").agg((F.max("number") + 1).alias("n")), "window"), F.col("window") == F.col("key_s"))
        return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number")).alias("sequence_id"), "offset")
