"""Mixing sources to target weights by Pfair scheduling.

Time is a row of slots, each of which takes one block of documents of one source. Block k of a source with share w may
start at slot floor(k / w) and must be done by slot ceil((k + 1) / w); of the blocks that may start, the one with the earliest
deadline gets the slot. So after any number of slots each source is less than one block from its share, for as long as it
has documents; a source that runs dry leaves its slots empty, and all documents of all sources are kept.

The driver makes the schedule of all blocks from the exact weights, as whole numbers without rounding, so the deviation stays
below one block however many documents there are. It holds one block a source and writes ``CHUNK`` blocks at a time. A block
has ``block_docs`` documents, or more where there would be over ``max_blocks`` blocks, which bounds the driver's time: the mix
is as fine as one part in ``max_blocks`` of all documents. Where ``period`` is given, shares are rounded to whole slots of it and one period's
schedule is repeated instead. Documents are ranked within their source by counting over hash buckets; no source meets in one task.

Edge cases: a null source is a source of its own; texts and other columns play no part; rows that repeat a doc_id each get a
place; a null doc_id is dealt like others; an empty table gives an empty result. More than ``MAX_SOURCES`` sources are an error, as
are weights that aren't above 0 or are so small that slots don't fit 62 bits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranking import ranked
from millrace.llm.store import materialise, small

MAX_SOURCES = 50_000
BLOCK_DOCS = 16
#: Blocks of the schedule that the driver holds at once.
CHUNK = 1 << 18
#: Blocks of a schedule at most.
MAX_BLOCKS = 1 << 22
#: Target shares are the sources' counts to this power, where no weights are given.
TEMPERATURE = 0.5
_SLOT = pa.schema([("key_s", pa.string()), ("k_s", pa.int64()), ("slot_s", pa.int64()), ("release_s", pa.int64()), ("deadline_s", pa.int64())])


def slots_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period by largest remainders, at least one a source."""
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    got = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(got.values())]:
        got[s] += 1
    return got


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period, whose length is the sum of the shares."""
    period = sum(shares.values())
    jobs = sorted((k * period // n, -(-(k + 1) * period // n), s, k) for s, n in shares.items() for k in range(n))
    out, ready, at = [], [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, s, k = jobs[at]
            heapq.heappush(ready, (deadline, s, k, release))
            at += 1
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, deadline))
    return out


def schedule_all(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks, by slot, with windows of the exact weights."""
    if not all(w > 0 and math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be above 0")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: x.numerator * (scale // x.denominator) for s, x in exact.items()}
    total = sum(whole.values())
    if any(-(-blocks[s] * total // n) >= 1 << 62 for s, n in whole.items()):
        raise ValueError("a weight is too small for its source's documents")
    # One block a source, the next one, waits for its release or is ready.
    ready, waiting, slot = [(-(-total // n), s, 0, 0) for s, n in whole.items() if blocks[s]], [], 0
    heapq.heapify(ready)
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // whole[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, slot, release, deadline
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // whole[s], s, k + 1))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, max_blocks: int = MAX_BLOCKS, period: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, source_rank, block, release, deadline, slot (and the struct ``_row`` of columns to keep).

    In the order of slot and source_rank the sources are mixed to their weights. ``weights``: by source; those it doesn't name
    get the least one.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("_key"), *([F.struct(*keep).alias("_row")] if keep else []))
    counts = {r["_key"]: r["count"] for r in rows.groupBy("_key").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights:
        named = {"" if s is None else f"={s}": w for s, w in weights.items()}
        targets = {s: named.get(s, min(named.values())) for s in counts}
    else:
        targets = {s: n**TEMPERATURE for s, n in counts.items()}
    shares = slots_of(targets, max(period, 8 * len(counts))) if period and counts else {}
    span = sum(shares.values())
    block_docs = max(block_docs, -(-sum(counts.values()) // max_blocks))
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    rows_of = schedule(shares) if period else schedule_all(targets, blocks)
    chunks = [materialise(small(spark, part, _SLOT), "slots") for part in batched(rows_of, CHUNK)]
    table = reduce(DataFrame.unionAll, chunks) if chunks else small(spark, [], _SLOT)
    placed = ranked(rows, "_key", ["doc_id"], ["doc_id"], max(64, sum(counts.values()) // 20_000), "source_rank")
    # The block's number within the schedule: all of them, or one period's share.
    sizes = small(spark, sorted((shares or blocks).items()), pa.schema([("key_n", pa.string()), ("n", pa.int64())]))
    placed = placed.join(F.broadcast(sizes), F.col("_key") == F.col("key_n")).withColumn("block", F.floor(F.col("source_rank") / block_docs))
    placed = placed.withColumn("k", F.col("block") % F.col("n")).withColumn("_past", F.floor(F.col("block") / F.col("n")) * span)
    made = placed.join(table, (F.col("_key") == F.col("key_s")) & (F.col("k") == F.col("k_s")))
    late = lambda c: (F.col("_past") + F.col(f"{c}_s")).cast("long").alias(c)
    return made.select("doc_id", "source", "source_rank", F.col("block").cast("long").alias("block"), late("release"), late("deadline"), late("slot"), *(["_row"] if keep else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` in the mixed order: partitions follow each other, and each is sorted."""
    made = mix(docs, keep=tuple(docs.columns), **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartitionByRange(parts, "slot", "source_rank").sortWithinPartitions("slot", "source_rank").select("_row.*")
