"""Posting blocks: many (key, id) entries of one bucket packed into one row.

An inverted index over all records has hundreds of entries for each record. As
rows, they would cost Spark far more than the entries themselves; as sorted
blocks with one byte plane per key byte they compress well (the high planes of
sorted keys are almost constant) and the engine moves few rows. A block holds
entries of one bucket; buckets are ranges of the key, as many as the input
needs for each to stay within a task's memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._textkernel import U64

KEY_BYTES, ID_BYTES = 6, 5
ID_MASK = (1 << (8 * ID_BYTES)) - 1
#: Entries that a map task gathers before it writes them out as blocks.
FLUSH = 1_500_000
#: Entries that one bucket is planned to hold.
PER_BUCKET = 4_000_000


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian byte planes of an unsigned array: all lowest bytes first."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(buf: bytes, width: int, n: int, offset: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(buf, np.uint8, width * n, offset).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the (uniformly distributed) 64-bit key."""
    return (((key >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


_HEAD = struct.Struct("<BII")


def encode_block(
    key: np.ndarray, ids: np.ndarray, key_bytes: int = KEY_BYTES, extra: list[tuple[np.ndarray, int]] = (), id_bytes: int = ID_BYTES, of_id: list[tuple[np.ndarray, int]] = ()
) -> bytes:
    """Entries as bytes. Where ids repeat often, they are written once (with what follows from the id alone), with a two-byte index for each entry."""
    n = len(key)
    # As np.unique with its indices, whose stable sort is several times slower; any place of an id will do.
    order = np.argsort(ids)
    new = np.ones(n, bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    first, index = order[new], np.empty(n, np.int64)
    table, index[order] = ids[first], np.cumsum(new) - 1
    width = id_bytes + sum(w for _, w in of_id)
    short = len(table) < 65536 and len(table) * width + 2 * n < width * n
    if short:
        body = planes(table, id_bytes) + b"".join(planes(x[first], w) for x, w in of_id) + planes(index.astype(U64), 2)
    else:
        body = planes(ids, id_bytes) + b"".join(planes(x, w) for x, w in of_id)
    return _HEAD.pack(short, n, len(table)) + planes(key >> U64(64 - 8 * key_bytes), key_bytes) + body + b"".join(planes(x, w) for x, w in extra)


def pack(
    key: np.ndarray,
    ids: np.ndarray,
    buckets: int,
    extra: list[tuple[np.ndarray, int]] = (),
    key_bytes: int = KEY_BYTES,
    id_bytes: int = ID_BYTES,
    of_id: list[tuple[np.ndarray, int]] = (),
) -> Iterator[tuple[int, bytes]]:
    """Blocks (bucket, bytes) of entries sorted by key; neighbouring repeats are written once.

    ``extra`` has further columns as (array, bytes of each entry), which must
    follow from key and id; those in ``of_id`` follow from the id alone.
    """
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, order = key[new], ids[new], order[new]
    cols, own = ([(x[order], w) for x, w in c] for c in (extra, of_id))
    cut = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        yield int(b), encode_block(key[s], ids[s], key_bytes, [(x[s], w) for x, w in cols], id_bytes, [(x[s], w) for x, w in own])


def unpack(blob: bytes, widths: tuple[int, ...] = (), key_bytes: int = KEY_BYTES, id_bytes: int = ID_BYTES, of_id: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Key (its leading bytes), id, what follows from the id, and further columns of a block."""
    short, n, d = _HEAD.unpack_from(blob)
    at = _HEAD.size
    out = [unplanes(blob, key_bytes, n, at)]
    at += key_bytes * n
    for w in (id_bytes, *of_id):
        out.append(unplanes(blob, w, d if short else n, at))
        at += w * (d if short else n)
    if short:
        index = unplanes(blob, 2, n, at).astype(np.int64)
        at += 2 * n
        out[1:] = [x[index] for x in out[1:]]
    for w in widths:
        out.append(unplanes(blob, w, n, at))
        at += w * n
    return out


def rows(items: Iterator[tuple], schema: pa.Schema, limit: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``limit`` bytes in their binary columns."""
    part, size = [], 0
    for item in items:
        part.append(item)
        size += sum(len(x) for x in item if isinstance(x, bytes)) + 16
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


#: Catalyst's estimate for a source of unknown size is of this order.
_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, without running it; 0 where it is unknown."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - an estimate only; without it the session's default holds
        return 0
    return size if size < _UNKNOWN else 0


def least_buckets(spark: SparkSession) -> int:
    return min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4096)


def bucket_count(df: DataFrame, entries_per_byte: float, least: int | None = None) -> int:
    """Buckets so that each holds about PER_BUCKET entries, and no fewer than ``least`` (the shuffle partitions)."""
    need = int(input_bytes(df) * entries_per_byte / PER_BUCKET) + 1
    return max(least_buckets(df.sparkSession) if least is None else least, need)


def slots(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket, such that hash partitioning by it puts each bucket into a partition of its own.

    Blocks that are joined by bucket carry these instead of the bucket's own
    number, whose hashes would fall together.
    """
    found: dict[int, int] = {}
    at = 0
    while len(found) < buckets:
        rows = spark.range(at, at + 4 * buckets + 64).select(F.col("id").cast("int").alias("i"))
        for r in rows.select("i", F.pmod(F.hash("i"), F.lit(buckets)).alias("p")).collect():
            found.setdefault(r["p"], r["i"])
        at += 4 * buckets + 64
    return [found[b] for b in range(buckets)]


def by_bucket(df: DataFrame, buckets: int, column: str = "bucket") -> DataFrame:
    """One partition for each bucket, by its number itself (no hash collisions)."""
    return df.repartitionById(buckets, column)
