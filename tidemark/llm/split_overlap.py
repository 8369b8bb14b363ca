"""Records of evaluation splits that also occur in the training split.

Method. Minwise hashes of word triples in buckets. Training texts post the
hashes of all their distinct triples, each a band of its own, because an
evaluation text may stand inside a much longer training text: then the sets are
unequal in size, and minima of the whole training text would miss it. An
evaluation text asks for its own minima only. They are taken in an order that
is the same for all texts: by how many training texts hold the triple (on a
logarithmic scale, counted in the buckets), then by its hash. A text of n
triples may lack n - ceil(t n) of them at threshold t, so with HITS minima more
*every* qualifying pair meets at least that often (in all its needed triples,
if they are fewer). Evaluation texts are told apart by all 64 bits of their
hash: but for two texts equal in it, the candidate stage is exact, not
probabilistic. Boilerplate is hardly ever asked for. Buckets hold roles, hence
only cross-split candidates arise. The texts of candidates are then compared
exactly (containment and Jaccard similarity of their triples), and confirmed
pairs can be counted by part and source.

Scale. Copies of a text, however many, are one text in the postings and one to
verify; only confirmed pairs meet record ids. Postings travel as packed blocks
of key ranges, each in a partition of its own; they are exchanged once and read
by both rounds. Texts are shuffled once, by their hash; the postings and both
sides of the verification read that one exchange.

Defined cases. Null, empty and blank texts and texts without a letter or digit
overlap with nothing. Repeated rows of the split count once; rows without a
part, or with a part that is neither training nor evaluation, and records
without a row are left out. A record does not overlap with itself, should it be
in two parts. An empty table gives an empty result. Other columns are ignored,
whatever their names. The threshold itself counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _blocks, _cluster, _texts
from tidemark.llm import _textkernel as tk
from tidemark.llm._texts import identified, text_members
from tidemark.llm._textkernel import U64

TRAIN, EVAL, ASKED = 0, 1, 2
#: Buckets in which a candidate pair must meet.
HITS = 2
#: Bytes of a triple's hash in the blocks. Different triples of equal bytes only add candidates.
KEY = 5
#: Bytes of a text's hash in the blocks: all of it.
ID = 8


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of n triples must be shared: the least integer of at least threshold * n."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _roles_by_bucket(slots: list[int]):
    """Blocks of (text, roles) for the buckets of the texts."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            tid, roles = _texts.tids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(U64)
            order = np.argsort(tid)
            tid, roles = tid[order], roles[order]
            cut = np.searchsorted(_blocks.bucket_of(tid, len(slots)), np.arange(len(slots) + 1))
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                yield slots[b], _texts.PAIRS, _blocks.planes(tid[s], 8) + _blocks.planes(roles[s], 1)

    return lambda batches: _blocks.rows(items(batches), _texts.SCHEMA)


def _post(slots: list[int]):
    """From texts and their roles: blocks of (triple, text) by role."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        blobs = _texts.by_kind(batches)
        if _texts.PAIRS not in blobs:
            return
        given = [(_blocks.unplanes(x, 8, len(x) // 9), _blocks.unplanes(x, 1, len(x) // 9, len(x) // 9 * 8)) for x in blobs[_texts.PAIRS]]
        tid, roles = (np.concatenate(x) for x in zip(*given, strict=True))
        here = _texts.Texts(blobs.get(_texts.TEXT, []))
        texts = [here.texts[i] for i in here.places(tid).tolist()]
        held: dict[int, list] = {TRAIN: [], EVAL: []}
        size = {TRAIN: 0, EVAL: 0}

        def flush(role: int) -> Iterator[tuple[int, int, bytes]]:
            if held[role]:
                key, ids = (np.concatenate(x) for x in zip(*held[role], strict=True))
                held[role], size[role] = [], 0
                for b, blob in _blocks.pack(key, ids, len(slots), key_bytes=KEY, id_bytes=ID):
                    yield slots[b], role, blob

        for at, part in tk.chunks(texts):
            key, off = tk.distinct_sets(part)
            doc = at + tk.owners(off)
            for r in (TRAIN, EVAL):
                m = (roles[doc] >> U64(r)) & U64(1) == 1
                held[r].append((key[m], tid[doc[m]]))
                size[r] += int(m.sum())
                if size[r] > _blocks.FLUSH:
                    yield from flush(r)
        yield from flush(TRAIN)
        yield from flush(EVAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks.rows(items(batches), _texts.SCHEMA)

    return run


def _by_key(blobs: list[bytes], widths: tuple[int, ...] = ()) -> list[np.ndarray]:
    """The entries of blocks, sorted by key."""
    cols = [np.concatenate(x) for x in zip(*(_blocks.unpack(x, widths, KEY, ID) for x in blobs), strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def rarity(count: np.ndarray) -> np.ndarray:
    """A byte that grows with the logarithm of the count, up to four billion."""
    return np.minimum(np.floor(8 * np.log2(count + 1.0)), 255).astype(U64)


def _rarity(buckets: int):
    """Blocks by evaluation text: each of its triples with how many training texts hold it."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held: dict[int, list[bytes]] = {TRAIN: [], EVAL: []}
        for batch in batches:
            for role, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[role].append(blob)
        if not held[EVAL]:
            return
        key, ids = _by_key(held[EVAL])
        unique, inverse = np.unique(key, return_inverse=True)
        count = np.zeros(len(unique), np.int64)
        for blob in held[TRAIN]:
            tkey = _blocks.unpack(blob, (), KEY, ID)[0]
            at = np.minimum(np.searchsorted(unique, tkey), len(unique) - 1)
            count += np.bincount(at[unique[at] == tkey], minlength=len(unique))
        df = rarity(count)[inverse]
        # Ids are uniform hashes: their ranges are the buckets.
        order = np.argsort(ids, kind="stable")
        key, ids, df = key[order], ids[order], df[order]
        cut = np.searchsorted(_blocks.bucket_of(ids, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            s = slice(cut[b], cut[b + 1])
            yield int(b), _blocks.encode_block(key[s] << U64(64 - 8 * KEY), ids[s], KEY, [(df[s], 1)], ID)

    return lambda batches: _blocks.rows(items(batches), schema)


def chosen(ids: np.ndarray, key: np.ndarray, df: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The minima that evaluation texts ask for, and the weight of each: a qualifying pair gathers HITS."""
    order = np.lexsort((key, df, ids))
    _, first, n = np.unique(ids[order], return_index=True, return_counts=True)
    need = needed(n, threshold)
    size = np.repeat(n - need + np.minimum(HITS, need), n)
    take = np.arange(len(ids)) - np.repeat(first, n) < size
    return order[take], np.repeat(-(-HITS // need), n)[take]


def _ask(slots: list[int], threshold: float):
    schema = _texts.SCHEMA

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        blobs = [x.as_py() for batch in batches for x in batch.column(1)]
        if blobs:
            key, ids, df = _by_key(blobs, (1,))
            keep, weight = chosen(ids, key, df, threshold)
            for b, blob in _blocks.pack(key[keep] << U64(64 - 8 * KEY), ids[keep], len(slots), [(weight.astype(U64), 1)], KEY, ID):
                yield slots[b], ASKED, blob

    return lambda batches: _blocks.rows(items(batches), schema)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a bucket, the pairs of evaluation and training texts that meet."""
    asked, posted = [], []
    for batch in batches:
        for role, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if role != EVAL:
                (asked if role == ASKED else posted).append(blob)
    if not asked:
        return
    key, ids, weight = _by_key(asked, (1,))
    unique, start, count = np.unique(key, return_index=True, return_counts=True)
    for blob in posted:
        tkey, tid = _blocks.unpack(blob, (), KEY, ID)
        at = np.minimum(np.searchsorted(unique, tkey), len(unique) - 1)
        hit = np.flatnonzero(unique[at] == tkey)
        # Slices of about a million pairs, however often a key repeats.
        for lo, hi in _slices(np.cumsum(count[at[hit]]), 1_000_000):
            x = hit[lo:hi]
            n = count[at[x]]
            q = np.repeat(start[at[x]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q].view(np.int64)), pa.array(np.repeat(tid[x], n).view(np.int64)), pa.array(weight[q].astype(np.int32))],
                names=["q", "t", "hits"],
            )


def _slices(grown: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(grown):
        base = grown[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(grown, base + limit, "right")))
        yield lo, hi
        lo = hi


def _confirm(threshold: float):
    def compare(q: np.ndarray, left: list[str], t: np.ndarray, right: list[str]) -> pa.RecordBatch:
        a, b, c = tk.common_triples(left, right)
        ok = (c > 0) & (c >= needed(a, threshold))
        cols = [pa.array(q[ok]), pa.array(t[ok]), pa.array(c[ok] / a[ok]), pa.array(c[ok] / (a + b - c)[ok])]
        return pa.RecordBatch.from_arrays(cols, names=["q", "t", "containment", "jaccard"])

    return compare


def cross_split_overlaps(
    records: DataFrame,
    members: DataFrame,
    *,
    id_col: str = "record_id",
    text_col: str = "text",
    member_id_col: str = "record_id",
    part_col: str = "part",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("dev", "test"),
    threshold: float = 0.8,
) -> DataFrame:
    """Confirmed pairs (eval_id, train_id, containment, jaccard); see the module for the cases."""
    spark = records.sparkSession
    _cluster.ship(spark)
    docs = identified(records, id_col, text_col)
    role = F.when(F.col("part").isin(*train), TRAIN).when(F.col("part").isin(*evaluation), EVAL)
    split = members.select(F.col(member_id_col).alias("record_id"), F.col(part_col).alias("part")).select("record_id", role.alias("role"))
    split = split.where("role is not null and record_id is not null").distinct()
    # Ids without texts, read three times below.
    placed = _cluster.stored(text_members(docs).join(split, "record_id").select("tid", "record_id", "role"), "placed")
    roles = placed.groupBy("tid").agg(F.bit_or(F.when(F.col("role") == EVAL, 1 << EVAL).otherwise(1 << TRAIN)).alias("roles"))
    held = _blocks.slots(spark, _texts.bucket_count(docs))
    texts = _texts.text_blocks(docs, held)
    given = roles.mapInArrow(_roles_by_bucket(held), _texts.KIND).repartition(len(held), "bucket")
    buckets = _blocks.bucket_count(docs, 1 / 8)
    slots = _blocks.slots(spark, buckets)
    posts = texts.unionByName(given).groupBy("bucket").applyInArrow(_post(slots), _texts.KIND)
    posted = posts.repartition(buckets, "bucket")
    rare = posted.mapInArrow(_rarity(buckets), "bucket int, block binary")
    asked = _blocks.by_bucket(rare, buckets).mapInArrow(_ask(slots, threshold), _texts.KIND).repartition(buckets, "bucket")
    # Both sides are partitioned alike, so they meet without another exchange.
    met = posted.unionByName(asked).groupBy("bucket").applyInArrow(_meet, "q long, t long, hits int")
    found = met.groupBy("q", "t").agg(F.sum("hits").alias("hits")).where(f"hits >= {HITS}").select(F.col("q").alias("a"), F.col("t").alias("b"))
    confirmed = _texts.compared(texts, found, held, _confirm(threshold), "q long, t long, containment double, jaccard double")
    asking = placed.where(f"role = {EVAL}").select(F.col("tid").alias("q"), F.col("record_id").alias("eval_id"))
    known = placed.where(f"role = {TRAIN}").select(F.col("tid").alias("t"), F.col("record_id").alias("train_id"))
    pairs = confirmed.join(asking, "q").join(known, "t").where("eval_id != train_id")
    return pairs.select("eval_id", "train_id", "containment", "jaccard").dropDuplicates(["eval_id", "train_id"])


def overlap_report(overlaps: DataFrame, records: DataFrame, members: DataFrame) -> DataFrame:
    """Confirmed pairs by part and source of the evaluation record: (part, source, pairs, records)."""
    part = members.where("part is not null").select(F.col("record_id").alias("eval_id"), "part").distinct()
    source = records.select(F.col("record_id").alias("eval_id"), "source").distinct()
    return (
        overlaps.groupBy("eval_id")
        .agg(F.count("*").alias("pairs"))
        .join(part, "eval_id")
        .join(source, "eval_id")
        .groupBy("part", "source")
        .agg(F.sum("pairs").alias("pairs"), F.count("*").alias("records"))
    )
