"""Token matrices by best-fit-decreasing packing, as binary rows ready to write.

A task tokenises its documents as they come and packs them in blocks of at most ``block_tokens``, so its memory has a bound and
no text is shuffled. In a block, pieces go longest first into the fullest sequence that still holds them, which a segment
tree over free capacities finds. Overlong documents are cut into full sequences and a rest, without loss.

A sequence's id is its partition's number and its place there: the same input split alike gives the same ids, also when a
task runs again on another executor.

Edge cases: null and empty texts are one end id; repeated rows are packed as often as they stand there; a null doc_id
stays null in ``doc_ids``; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import END_ID, WIDTH, document_ids

SIZE = 2048
BLOCK_TOKENS = 4_000_000
_ROW = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


class Capacities:
    """Open sequences by free capacity. A segment tree counts them, so the least capacity that suffices is found in
    as many steps as the tree is deep."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(self._leaves)]

    def _add(self, capacity: int, n: int) -> None:
        node = self._leaves + capacity
        while node:
            self._count[node] += n
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self._open[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the fullest one with at least ``least`` free, or None."""
        node = self._leaves + least
        if not self._count[node]:
            while node > 1 and (node & 1 or not self._count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if self._count[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        self._add(capacity, -1)
        return capacity, self._open[capacity].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of piece numbers, by best fit decreasing."""
    room, sequences = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        capacity, at = found if found else (size, len(sequences))
        if not found:
            sequences.append([])
        sequences[at].append(i)
        if capacity > lengths[i]:
            room.put(capacity - lengths[i], at)
    return sequences


def matrices(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a sequence: sequence_id, n_tokens (without padding), input_ids and position_ids (``size`` little-endian
    unsigned 32-bit numbers; positions restart at each piece, padding has 0), cu_seqlens (0 and each piece's end), doc_ids and
    starts (of the pieces: document, and ids of it before the piece)."""
    ramp = np.arange(size, dtype="<u4")

    def packed(block: list[tuple[int | None, int, bytes]], first: int) -> pa.RecordBatch:
        rows = []
        for k, members in enumerate(best_fit([len(b) // WIDTH for _, _, b in block], size)):
            parts = [block[i] for i in members]
            ends = np.cumsum([0, *(len(b) // WIDTH for _, _, b in parts)])
            ids = b"".join(b for _, _, b in parts) + pad_id.to_bytes(WIDTH, "little") * (size - int(ends[-1]))
            positions = np.zeros(size, "<u4")
            for a, b in zip(ends, ends[1:], strict=False):
                positions[a:b] = ramp[: b - a]
            rows.append((first + k, int(ends[-1]), ids, positions.tobytes(), ends.tolist(), [d for d, _, _ in parts], [s for _, s, _ in parts]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, int, bytes]] = []
        held = 0
        for doc_id, ids in document_ids(batches, path, end_id):
            for at in range(0, len(ids), size * WIDTH):
                piece = ids[at : at + size * WIDTH]
                block.append((doc_id, at // WIDTH, piece))
                held += len(piece) // WIDTH
                if held >= block_tokens:
                    made = packed(block, first)
                    first += made.num_rows
                    yield made
                    block, held = [], 0
        if block:
            yield packed(block, first)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROW)


def write_matrices(docs: DataFrame, out: str, path: str, **options) -> None:
    """The rows of ``matrices`` as Parquet: id matrix, cumulative segment lengths and position resets side by side."""
    matrices(docs, path, **options).write.mode("overwrite").parquet(out)
