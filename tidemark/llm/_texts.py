"""Distinct texts as compressed blocks by ranges of their hash, and the comparison of pairs of them.

A text is sent once, whatever the number of its copies within a task, in blocks
that compress far better than rows. Pairs are compared in two steps: at the
left text, which is packed for the bucket of the right one (once for all of its
partners there), and at the right text, where both are at hand.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _blocks
from tidemark.llm import _textkernel as tk
from tidemark.llm._textkernel import U64

TEXT, PAIRS, LEFT = 0, 1, 2
KIND = "bucket int, kind int, block binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
#: Characters that a task holds before it writes them out, and pairs compared at once.
FLUSH_CHARS, FLUSH_PAIRS = 24_000_000, 4_000
#: Bytes of compressed input that one bucket of texts is planned for.
BUCKET_BYTES = 12_000_000
_HEAD = struct.Struct("<IQ")


def present(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (record_id, text) with an id and a text that is not blank, under fixed names."""
    return df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).where(
        F.col("record_id").isNotNull() & F.col("text").rlike(r"\S")
    )


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (record_id, text, tid) with an id and a text that is not blank."""
    return present(df, id_col, text_col).select("record_id", "text", F.xxhash64("text").alias("tid"))


def text_members(docs: DataFrame) -> DataFrame:
    """(tid, record_id): which records have a text; repeated rows once. The copies of a text are spread over all tasks."""
    return docs.select("tid", "record_id").distinct()


def bucket_count(docs: DataFrame, least: int | None = None) -> int:
    """Buckets of texts, so that one bucket's texts fit into a task."""
    return max(_blocks.least_buckets(docs.sparkSession) if least is None else least, _blocks.input_bytes(docs) // BUCKET_BYTES + 1)


def tids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def encode(tid: np.ndarray, texts: list[str]) -> bytes:
    """Hashes of texts and the texts, compressed."""
    raw = "".join(texts).encode("utf-8", "surrogatepass")
    size = np.array([len(t) for t in texts], U64)
    return _HEAD.pack(len(texts), len(raw)) + _blocks.planes(tid, 8) + _blocks.planes(size, 4) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def decode(blob: bytes) -> tuple[np.ndarray, list[str]]:
    n, size = _HEAD.unpack_from(blob)
    at = _HEAD.size
    tid, length = _blocks.unplanes(blob, 8, n, at), _blocks.unplanes(blob, 4, n, at + 8 * n)
    raw = pa.Codec("zstd").decompress(blob[at + 12 * n :], size, asbytes=True).decode("utf-8", "surrogatepass")
    end = np.cumsum(length).astype(np.int64).tolist()
    return tid, [raw[a:b] for a, b in zip([0, *end], end, strict=False)]


class Texts:
    """The texts of a bucket by their hash."""

    def __init__(self, blobs: list[bytes]) -> None:
        found = [decode(b) for b in blobs]
        tid = np.concatenate([t for t, _ in found]) if found else np.empty(0, U64)
        every = [t for _, ts in found for t in ts]
        self.tid, first = np.unique(tid, return_index=True)
        self.texts = [every[i] for i in first.tolist()]

    def places(self, tid: np.ndarray) -> np.ndarray:
        """The place of each text; all must be here."""
        at = np.searchsorted(self.tid, tid)
        if len(tid) and (len(self.tid) == 0 or (self.tid[np.minimum(at, len(self.tid) - 1)] != tid).any()):
            raise KeyError("a text is not in its bucket")
        return at


def packed(slots: list[int]):
    """Blocks of the distinct texts of a task from rows (tid, text)."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held: dict[int, str] = {}
        chars = 0
        for batch in batches:
            for t, text in zip(tids(batch.column(0)).tolist(), batch.column(1).to_pylist(), strict=True):
                if t not in held:
                    held[t] = text
                    chars += len(text)
                    if chars > FLUSH_CHARS:
                        yield from _by_bucket(held, slots)
                        held, chars = {}, 0
        if held:
            yield from _by_bucket(held, slots)

    return lambda batches: _blocks.rows(items(batches), SCHEMA)


def _by_bucket(held: dict[int, str], slots: list[int]) -> Iterator[tuple[int, int, bytes]]:
    tid, texts = np.array(list(held), U64), list(held.values())
    order = np.argsort(tid)
    cut = np.searchsorted(_blocks.bucket_of(tid[order], len(slots)), np.arange(len(slots) + 1))
    for b in np.flatnonzero(np.diff(cut)):
        part = order[cut[b] : cut[b + 1]]
        yield slots[b], TEXT, encode(tid[part], [texts[i] for i in part.tolist()])


def text_blocks(docs: DataFrame, slots: list[int]) -> DataFrame:
    """(bucket, kind, block): the distinct texts of (tid, text) rows, each bucket in a partition of its own."""
    blocks = docs.select("tid", "text").mapInArrow(packed(slots), KIND)
    return blocks.repartition(len(slots), "bucket")


def by_kind(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out.setdefault(kind, []).append(blob)
    return out


def _route(slots: list[int]):
    """Blocks of pairs for the buckets of their left texts."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            a, b = tids(batch.column(0)), tids(batch.column(1))
            order = np.argsort(a)
            a, b = a[order], b[order]
            cut = np.searchsorted(_blocks.bucket_of(a, len(slots)), np.arange(len(slots) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                yield slots[k], PAIRS, _blocks.planes(a[s], 8) + _blocks.planes(b[s], 8)

    return lambda batches: _blocks.rows(items(batches), SCHEMA)


def _at_left(slots: list[int]):
    """Left texts, packed for the buckets of the right ones, with their pairs."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        blobs = by_kind(batches)
        pairs = [_two(x) for x in blobs.get(PAIRS, ())]
        if not pairs:
            return
        here = Texts(blobs.get(TEXT, []))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((a, _blocks.bucket_of(b, len(slots))))
        a, b = a[order], b[order]
        place, to = here.places(a), _blocks.bucket_of(b, len(slots))
        size = np.array([len(t) for t in here.texts], np.int64)
        new = np.append(True, (a[1:] != a[:-1]) | (to[1:] != to[:-1]))
        grown = np.cumsum(np.where(new, size[place], 0) + 20)
        lo = 0
        while lo < len(a):
            base = grown[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(grown, base + FLUSH_CHARS // 4, "right"))), int(np.searchsorted(to, to[lo], "right")))
            own, index = np.unique(place[lo:hi], return_inverse=True)
            head = encode(here.tid[own], [here.texts[i] for i in own.tolist()])
            n = hi - lo
            yield slots[int(to[lo])], LEFT, struct.pack("<Q", n) + _blocks.planes(index.astype(U64), 4) + _blocks.planes(b[lo:hi], 8) + head
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks.rows(items(batches), SCHEMA)

    return run


def _two(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    return _blocks.unplanes(blob, 8, n), _blocks.unplanes(blob, 8, n, 8 * n)


def _at_right(compare: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = by_kind(batches)
        if LEFT not in blobs:
            return
        here = Texts(blobs.get(TEXT, []))
        for blob in blobs[LEFT]:
            (n,) = struct.unpack_from("<Q", blob)
            index, b = _blocks.unplanes(blob, 4, n, 8).astype(np.int64), _blocks.unplanes(blob, 8, n, 8 + 4 * n)
            tid, texts = decode(blob[8 + 12 * n :])
            place = here.places(b)
            for at in range(0, n, FLUSH_PAIRS):
                i, j = index[at : at + FLUSH_PAIRS], place[at : at + FLUSH_PAIRS]
                left, right = [texts[x] for x in i.tolist()], [here.texts[x] for x in j.tolist()]
                # Long texts go in smaller portions.
                for k, part in tk.chunks([x + y for x, y in zip(left, right, strict=True)]):
                    s = slice(k, k + len(part))
                    yield compare(tid[i[s]].view(np.int64), left[s], here.tid[j[s]].view(np.int64), right[s])

    return run


def compared(texts: DataFrame, pairs: DataFrame, slots: list[int], compare: Callable, schema: str) -> DataFrame:
    """``compare(a, texts of a, b, texts of b) -> RecordBatch`` over pairs (a, b) of texts; ``texts`` as of :func:`text_blocks`."""
    n = len(slots)
    asked = pairs.select("a", "b").mapInArrow(_route(slots), KIND).repartition(n, "bucket")
    left = texts.unionByName(asked).groupBy("bucket").applyInArrow(_at_left(slots), KIND)
    left = left.repartition(n, "bucket")
    return texts.unionByName(left).groupBy("bucket").applyInArrow(_at_right(compare), schema)
