"""Documents to token ids in Arrow batches, cut into pieces that fit a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from millrace.llm.bpe import encoder

#: Bytes of one id.
WIDTH = 4
END_ID = 1


def document_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of batches with columns doc_id, text; a null text is empty; every document ends with ``end_id``."""
    encode, end = encoder(path).encode, end_id.to_bytes(WIDTH, "little")
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc_id, (encode(text) if text else b"") + end
