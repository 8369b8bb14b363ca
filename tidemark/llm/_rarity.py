"""Counts of triples by ranges of their hash, over all texts; of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import _textkernel as tk
from tidemark.llm._textkernel import U64

#: Counts of triples are kept for ranges of their hash; a fixed number.
SLOTS, _PARTS = 1 << 20, 64


def slot(h: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The range of each triple hash."""
    return (h >> U64(64 - (slots.bit_length() - 1))).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, texts = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        texts += len(batch)
        for _, part in tk.chunks(batch.column(0).to_pylist()):
            count += np.bincount(slot(tk.distinct_sets(part)[0]), minlength=SLOTS)
    if texts:
        # Two bytes bound what a task sends; a larger count is common anyway. The last part is the number of texts.
        blobs = [x.tobytes() for x in np.minimum(count, 65535).astype("<u2").reshape(_PARTS, -1)] + [np.array([texts], "<u8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS + 1), pa.int32()), pa.array(blobs)], names=["part", "counts"])


def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(blob, "<u2" if part < _PARTS else "<u8").astype(np.int64)
    if total:
        blobs = [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() if part < _PARTS else x.astype("<u8").tobytes() for part, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs)], names=["part", "counts"])


def triple_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many distinct triples of texts fall into each of SLOTS ranges of their hash, 4 MB at any scale; and the number of texts."""
    kind = "part int, counts binary"
    rows = texts.mapInArrow(_count_slots, kind).repartition("part").mapInArrow(_sum_slots, kind).collect()
    out = np.zeros((_PARTS, SLOTS // _PARTS), np.uint32)
    n = 0
    for r in rows:
        if r["part"] < _PARTS:
            out[r["part"]] = np.frombuffer(r["counts"], "<u4")
        else:
            n = int(np.frombuffer(r["counts"], "<u8")[0])
    return out.ravel(), n
