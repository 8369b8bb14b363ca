"""Near-duplicate records by Order MinHash.

Method. The k-mers of a text are its word triples, each labelled with its
occurrence number, so that repeats count. Each hash function samples the two
labelled triples of least hash and keeps them in text order, so the sketch
follows the order of a text and not only its set of triples. Triples that at
least one text in ``COMMON`` holds (boilerplate) are sampled only where a text
has no others. Texts whose sketch agrees in one function become candidates.
Two kinds of text cannot rely on that: those that have a sketch in common with
more than ``hot`` texts, which makes no pairs by itself, and those of which
most triples are common. They are compared by their rarest distinct triples as
well, n - ceil(t n) + 1 of n at threshold t. Two of them that reach the
threshold have one of these in common, so no pair among them is lost. The sizes
of the texts and the places of the triple must allow the threshold. Which
triples are rare or common follows from counts by hash, of fixed size.

Candidates are verified by a banded alignment of their labelled triples: the
triples matched in order inside the band are common to both texts, and if they
reach the threshold the pair is proven. Where they do not, blocks of the texts
may have moved; the matches outside the band are added, wherever they stand.

Scale. Sketches are keyed by a hash of the text, so copies of a text, however
many, are one entry in every block (they are merged before the shuffle) and one
text to verify. Pairs are made and verified between distinct texts; only
verified ones meet record ids. A task sends at most ``hot`` + 1 entries of a
sketch at a time, so a hot sketch gathers as many of each task and nothing else.
Pairs inside a bucket of sketches are generated in bounded slices and never
held together. Texts are shuffled once, by their hash, in compressed blocks
that both sides of the verification read.

Defined cases. Null, empty and blank texts, and texts without a letter or
digit, are in no pair. A text of one or two words has one triple. Equal texts
of different ids are pairs of similarity 1; texts are taken for equal by 64
bits of their hash. Repeated rows (same id and text) count once. An empty table
gives an empty result. Other columns, whatever their names, are ignored. The
threshold itself counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _blocks, _cluster, _texts
from tidemark.llm import _textkernel as tk
from tidemark.llm._rarity import slot, triple_counts
from tidemark.llm._texts import identified, text_members
from tidemark.llm._textkernel import U64

#: Functions. Each one finds a pair at the threshold of 0.6 with a probability of 0.36, or about half of that where blocks of the text have moved.
SKETCHES = 40
#: Texts that one sketch may have in common before they are compared by their rarest triples.
HOT = 4
#: A triple is common that one text in so many holds; a text with a smaller share of other triples is compared by its rarest ones.
COMMON, UNCOMMON_SHARE = 100, 0.7
BAND = 8
#: Largest number of distinct triples kept with an entry; it stands for this many or more.
_MOST = 255
#: Bytes of a sketch's or triple's hash in the blocks (different ones of equal bytes only add candidates), and of a text's.
KEY, ID = 5, 8
SKETCH, HOT_TEXTS = 0, 1
_LOCAL_BITS = 22
_LABEL = U64(0xC2B2AE3D27D4EB4F)


def sketch_keys(texts: list[str], common: np.ndarray, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketch keys, shape (texts with a triple, sketches), the indices of those texts, their shares of uncommon triples and their numbers of distinct ones.

    ``common`` tells for each slot of hashes whether its triples are common.
    """
    h, off = tk.triples(*tk.words(texts))
    has = np.flatnonzero(np.diff(off))
    if not len(has):
        return np.empty((0, sketches), U64), has, np.empty(0), np.empty(0, np.int64)
    doc, count, start = tk.owners(off), np.diff(off)[has], off[has]
    nth = tk.occurrences(h, doc)
    x = labelled(h, nth)
    size = np.add.reduceat((nth == 0).astype(np.int64), start)
    late = common[slot(h, len(common))]
    share = 1 - np.add.reduceat(late.astype(np.int64), start) / count
    mask, full = U64((1 << _LOCAL_BITS) - 1), U64(0xFFFFFFFFFFFFFFFF)
    local = (np.arange(len(h)) - off[doc]).astype(U64) & mask
    tail = late.astype(U64) << U64(63) | local
    seeds = tk.mix(np.arange(1, 2 * sketches + 1, dtype=U64)).reshape(sketches, 2)
    out = np.empty((len(has), sketches), U64)
    y = np.empty_like(x)
    for j in range(sketches):
        np.bitwise_xor(x, seeds[j, 0], out=y)
        y *= seeds[j, 1] | U64(1)
        y >>= U64(1)
        y &= ~mask
        y |= tail
        one = start + (np.minimum.reduceat(y, start) & mask).astype(np.int64)
        y[one] = full
        two = np.where(count > 1, start + (np.minimum.reduceat(y, start) & mask).astype(np.int64), one)
        a, b = np.minimum(one, two), np.maximum(one, two)
        out[:, j] = tk.mix(x[a] * U64(0x9E3779B97F4A7C15) + tk.mix(x[b] + U64(j)))
    return out, has, share, size


def labelled(h: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Triples with their occurrence number in the text, as one hash."""
    return tk.mix(h + nth.astype(U64) * _LABEL)


def _sketch(buckets: int, sketches: int, hot: int, common):
    """Blocks of (sketch, text) entries with the size of the text; texts to be compared by rarest triples, as far as known here, by themselves."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held, amount = [], 0

        def flush() -> Iterator[tuple[int, int, bytes]]:
            keys, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            # The copies of a text are one, and texts in order of their hashes leave only the keys to sort.
            ids, one = np.unique(ids, return_index=True)
            key = keys[one].ravel()
            order = _by_lead(key)
            key, text = key[order], order // sketches
            ids, size = ids[text], sizes[one][text]
            place, many = _groups(key >> U64(64 - 8 * KEY))
            # One more than ``hot`` entries tell the receiver that the sketch is hot.
            for blob in _id_blocks(np.unique(ids[many > hot])):
                yield 0, HOT_TEXTS, blob
            few = place <= hot
            for b, blob in _blocks.pack(key[few], ids[few], buckets, (), KEY, ID, [(np.minimum(size[few], _MOST).astype(U64), 1)]):
                yield b, SKETCH, blob

        for batch in batches:
            tid = _texts.tids(batch.column(0))
            for at, part in tk.chunks(batch.column(1).to_pylist()):
                k, has, share, size = sketch_keys(part, common.value, sketches)
                for blob in _id_blocks(np.unique(tid[at + has[share < UNCOMMON_SHARE]])):
                    yield 0, HOT_TEXTS, blob
                held.append((k, tid[at + has], size))
                amount += k.size
                if amount > _blocks.FLUSH:
                    yield from flush()
                    held, amount = [], 0
        if amount:
            yield from flush()

    return lambda batches: _blocks.rows(items(batches), schema)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys, the place of each entry in its group and the size of the group."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    return np.arange(len(key)) - np.repeat(first, n), np.repeat(n, n)


def _by_lead(key: np.ndarray) -> np.ndarray:
    """The order of keys by their leading KEY bytes, and of equal ones by their places."""
    low = 64 - 8 * KEY
    if len(key) > 1 << low:
        return np.argsort(key >> U64(low), kind="stable")
    # Sorting numbers is far quicker than sorting places by them.
    both = key >> U64(low) << U64(low) | np.arange(len(key), dtype=U64)
    both.sort()
    return (both & U64((1 << low) - 1)).astype(np.int64)


def _repeated(key: np.ndarray) -> np.ndarray:
    """The places of keys that come more than once."""
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    return order[np.append(again, False) | np.append(False, again)] if len(key) else order


def _id_blocks(ids: np.ndarray, size: int = 100_000) -> Iterator[bytes]:
    for at in range(0, len(ids), size):
        yield _blocks.planes(ids[at : at + size], ID)


def rarest_keys(h: np.ndarray, off: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest of the distinct triples ``h`` of each text, as (key, text, place among its triples).

    The order (count, hash) is the same for all texts, so those that share at
    least ``threshold`` of their triples have one of these in common.
    """
    n = np.diff(off)
    doc = tk.owners(off)
    order = np.lexsort((h, counts[slot(h, len(counts))], doc))
    at = np.arange(len(h)) - np.repeat(off[:-1], n)
    take = at < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
    return tk.mix(h[order[take]]), doc[take], at[take]


def _rare(buckets: int, counts, threshold: float):
    """From texts and the hashes of those that are asked for: blocks of their rarest triples, with sizes and the places of the triples."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        blobs = _texts.by_kind(batches)
        wanted = [_blocks.unplanes(x, ID, len(x) // ID) for x in blobs.get(_texts.PAIRS, ())]
        if not wanted:
            return
        here = _texts.Texts(blobs.get(_texts.TEXT, []))
        place = here.places(np.unique(np.concatenate(wanted)))
        held, amount = [], 0

        def flush() -> Iterator[tuple[int, bytes]]:
            key, ids, size, at = (np.concatenate(x) for x in zip(*held, strict=True))
            few = lambda x: [(np.minimum(x, _MOST).astype(U64), 1)]
            yield from _blocks.pack(key, ids, buckets, few(at), KEY, ID, few(size))

        for at, part in tk.chunks([here.texts[i] for i in place.tolist()]):
            h, off = tk.distinct_sets(part)
            key, of, rank = rarest_keys(h, off, counts.value, threshold)
            held.append((key, here.tid[place[at + of]], np.diff(off)[of], rank))
            amount += len(key)
            if amount > _blocks.FLUSH:
                yield from flush()
                held, amount = [], 0
        if amount:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks.rows(items(batches), schema)

    return run


def _ids_by_bucket(slots: list[int]):
    """Blocks of the hashes of texts for the buckets of the texts."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            tid = np.sort(_texts.tids(batch.column(0)))
            cut = np.searchsorted(_blocks.bucket_of(tid, len(slots)), np.arange(len(slots) + 1))
            for b in np.flatnonzero(np.diff(cut)):
                yield slots[b], _texts.PAIRS, _blocks.planes(tid[cut[b] : cut[b + 1]], ID)

    return lambda batches: _blocks.rows(items(batches), _texts.SCHEMA)


def pairs_of(
    key: np.ndarray, ids: np.ndarray, limit: int = 1_000_000, extra: tuple[np.ndarray, ...] = (), keep: Callable | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different ids with an equal key, in slices; every pair of a group, at most twice ``limit`` at once.

    With ``keep``, only those for which it is true, given the ``extra`` values of both sides.
    """
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, extra = key[new], ids[new], [x[order][new] for x in extra]
    left, d, parts, held = np.arange(len(key)), 1, [], 0
    while len(left):
        left = left[left + d < len(key)]
        left = left[key[left] == key[left + d]]
        if len(left):
            good = left[keep([x[left] for x in extra], [x[left + d] for x in extra])] if keep else left
            parts.append((ids[good], ids[good + d]))
            held += len(good)
        if held >= limit:
            yield np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
            parts, held = [], 0
        d += 1
    if held:
        yield np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def reachable(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether texts of these (sizes, places of the first common triple, if known) can reach the threshold."""
    (n, *i), (m, *j) = ([x.astype(np.int64) for x in side] for side in (left, right))
    best = np.minimum(np.where(n < _MOST, n, 1 << 30), np.where(m < _MOST, m, 1 << 30))
    if i:
        best = np.minimum(np.where(n < _MOST, n - i[0], 1 << 30), np.where(m < _MOST, m - j[0], 1 << 30))
    return best >= threshold * (n + m - best) - 1e-9


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
    # The same pair often agrees in several functions of this bucket.
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], names=["a", "b"])


def _alone(ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.nulls(len(ids), pa.int64())], names=["a", "b"])


def _candidates(threshold: float, hot: int):
    """Pairs of texts that agree in a sketch; texts of hot sketches alone, with null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == HOT_TEXTS:
                    yield _alone(_blocks.unplanes(blob, ID, len(blob) // ID))
                else:
                    parts.append(_blocks.unpack(blob, (), KEY, ID, (1,)))
        if not parts:
            return
        key, ids, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Most sketches are those of one text, which needs no place among others.
        several = _repeated(key)
        if not len(several):
            return
        key, ids, size = key[several], ids[several], size[several]
        order = np.lexsort((ids, key))
        key, ids, size = key[order], ids[order], size[order]
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids, size = key[new], ids[new], size[new]
        many = _groups(key)[1]
        if (many > hot).any():
            yield _alone(np.unique(ids[many > hot]))
        few = (many > 1) & (many <= hot)
        for a, b in pairs_of(key[few], ids[few], extra=(size[few],), keep=lambda x, y: reachable(x, y, threshold)):
            yield _pair_batch(a, b)

    return run


def _rare_candidates(threshold: float):
    """Pairs of texts that have a rarest triple in common; one that qualifies passes at the first one that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_blocks.unpack(blob, (1,), KEY, ID, (1,)) for batch in batches for blob in batch.column(1).to_pylist()]
        if parts:
            key, ids, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            for a, b in pairs_of(key, ids, extra=(size, place), keep=lambda x, y: reachable(x, y, threshold)):
                yield _pair_batch(a, b)

    return run


def _in_band(xa: np.ndarray, oa: np.ndarray, weight: np.ndarray, xb: np.ndarray, ob: np.ndarray, band: int, need: np.ndarray | None = None) -> np.ndarray:
    """The greatest weight of matches in order between each pair of sequences, within a band around the diagonal.

    Pairs that cannot come to ``need`` any more are given up, with what they have.
    """
    na, nb = np.diff(oa), np.diff(ob)
    need = np.zeros(len(na)) if need is None else need
    out = np.zeros(len(na), np.int64)
    shift = np.arange(2 * band + 1) - band
    todo = np.argsort(na, kind="stable")
    xb = np.append(xb, U64(0))
    for at in range(0, len(todo), 4096):
        p = todo[at : at + 4096]
        best = np.zeros((len(p), len(shift)), np.int32)
        for i in range(int(na[p].max(initial=0))):
            if i % 4 == 0:
                most = best.max(axis=1)
                out[p] = most
                on = (na[p] > i) & (most + na[p] - i >= need[p])
                p, best = p[on], best[on]
            # Pairs are sorted by length, so those still running are at the end.
            live = int(np.searchsorted(na[p], i, "right"))
            q = p[live:]
            col = i + shift[None, :]
            inside = (col >= 0) & (col < nb[q][:, None])
            mine = oa[q] + i
            match = inside & (xb[np.where(inside, ob[q][:, None] + col, len(xb) - 1)] == xa[mine][:, None])
            d = best[live:]
            step = d + match * weight[mine][:, None]
            step[:, :-1] = np.maximum(step[:, :-1], d[:, 1:])
            best[live:] = np.maximum.accumulate(step, axis=1)
        out[p] = best.max(axis=1, initial=0)
    return out


def align(left: list[str], right: list[str], threshold: float, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of texts: distinct triples of either side, those in common as far as needed, whether the band alone proved the pair.

    A labelled triple counts once, at its first occurrence, so matches in the
    band never exceed the common triples.
    """
    n = len(left)
    h, off = tk.triples(*tk.words([*left, *right]))
    doc = tk.owners(off)
    nth = tk.occurrences(h, doc)
    first, x = nth == 0, labelled(h, nth)
    size = np.bincount(doc[first], minlength=2 * n)
    a, b = size[:n], size[n:]
    # Alignment works on the shorter side row by row.
    flip = np.diff(off)[:n] > np.diff(off)[n:]
    one, two = np.where(flip, np.arange(n) + n, np.arange(n)), np.where(flip, np.arange(n), np.arange(n) + n)
    common = _in_band(*_gathered(x, off, one), first[_positions(off, one)].astype(np.int32), *_gathered(x, off, two), band, threshold * (a + b) / (1 + threshold) - 1e-6)
    proven = (common > 0) & (common >= threshold * (a + b - common) - 1e-9)
    rest = np.flatnonzero(~proven)
    if len(rest):
        of = np.full(2 * n, -1)
        of[rest] = of[rest + n] = np.arange(len(rest))
        use = first & (of[doc] >= 0)
        key = tk.mix(h[use] + of[doc[use]].astype(U64) * _LABEL)
        # Distinct on either side, so that a key comes twice at most.
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        common[rest] = np.bincount(of[doc[use]][order][1:][same], minlength=len(rest))
    return a, b, common, proven


def _positions(off: np.ndarray, which: np.ndarray) -> np.ndarray:
    n = np.diff(off)[which]
    return np.repeat(off[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _gathered(x: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[_positions(off, which)], np.append(0, np.cumsum(np.diff(off)[which]))


def verify(left: list[str], right: list[str], threshold: float, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of texts: whether they reach the threshold, their common triples as far as counted, whether the band alone proved it."""
    a, b, common, proven = align(left, right, threshold, band)
    return (common > 0) & (common >= threshold * (a + b - common) - 1e-9), common, proven


def _verified(threshold: float, band: int):
    def compare(a: np.ndarray, left: list[str], b: np.ndarray, right: list[str]) -> pa.RecordBatch:
        ok, common, proven = verify(left, right, threshold, band)
        cols = [pa.array(a[ok]), pa.array(b[ok]), pa.array(common[ok].astype(np.int32)), pa.array(proven[ok])]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "aligned", "certified"])

    return compare


def near_duplicate_texts(docs: DataFrame, *, threshold: float = 0.8, sketches: int = SKETCHES, band: int = BAND, hot: int = HOT) -> DataFrame:
    """Pairs (a, b, aligned, certified) of different texts (record_id, text, tid) of a similarity of ``threshold`` or more."""
    spark = docs.sparkSession
    _cluster.ship(spark)
    counts, total = triple_counts(docs.select("text"))
    common = spark.sparkContext.broadcast(counts * float(COMMON) >= max(total, 1))
    buckets = _blocks.bucket_count(docs, sketches / 150)
    blocks = docs.select("tid", "text").mapInArrow(_sketch(buckets, sketches, hot, common), "bucket int, kind int, block binary")
    met = _cluster.stored(_blocks.by_bucket(blocks, buckets).mapInArrow(_candidates(threshold, hot), "a long, b long"), "met")
    slots = _blocks.slots(spark, _texts.bucket_count(docs))
    texts = _texts.text_blocks(docs, slots)
    # The texts of which sketches alone do not decide.
    asked = met.where("b is null").select("a").distinct().mapInArrow(_ids_by_bucket(slots), _texts.KIND)
    asked = asked.repartition(len(slots), "bucket")
    rare = texts.unionByName(asked).groupBy("bucket").applyInArrow(_rare(buckets, spark.sparkContext.broadcast(counts), threshold), "bucket int, block binary")
    more = _blocks.by_bucket(rare, buckets).mapInArrow(_rare_candidates(threshold), "a long, b long")
    pairs = met.where("b is not null").unionByName(more).distinct()
    return _texts.compared(texts, pairs, slots, _verified(threshold, band), "a long, b long, aligned int, certified boolean")


def near_duplicates(
    df: DataFrame, *, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.8, sketches: int = SKETCHES, band: int = BAND, hot: int = HOT
) -> DataFrame:
    """Pairs (record_a, record_b, aligned, certified) of records with a triple similarity of ``threshold`` or more.

    ``aligned`` counts the common triples that were needed, null for equal texts;
    ``certified`` tells whether the alignment in the band alone proved the pair
    (equal texts need none). See the module for the cases.
    """
    docs = identified(df, id_col, text_col)
    found = near_duplicate_texts(docs, threshold=threshold, sketches=sketches, band=band, hot=hot)
    members = text_members(docs)
    a, b = (members.select(F.col("tid").alias(x), F.col("record_id").alias(f"r{x}")) for x in ("a", "b"))
    apart = found.join(a, "a").join(b, "b").where("ra != rb")
    apart = apart.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"), "aligned", "certified")
    return apart.unionByName(_equal_texts(docs, members)).dropDuplicates(["record_a", "record_b"])


def _equal_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records with the same text, if it has a word."""
    worded = F.col("text").rlike(r"[\p{L}\p{N}]")
    several = docs.where(worded).groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid")
    copies = members.join(several, "tid")
    a, b = (copies.select("tid", F.col("record_id").alias(f"record_{x}")) for x in ("a", "b"))
    return a.join(b, "tid").where("record_a < record_b").select("record_a", "record_b", F.lit(None).cast("int").alias("aligned"), F.lit(True).alias("certified"))


def near_duplicate_links(
    df: DataFrame, *, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.8, sketches: int = SKETCHES, hot: int = HOT
) -> DataFrame:
    """One row for each record that has a near duplicate: (record_id, class_id, links).

    Equal texts are a class, named by its least record id; ``links`` counts the
    near-duplicate classes other than its own. The form for large groups of
    copies, whose pairs would grow with the square of the group.
    """
    docs = identified(df, id_col, text_col)
    found = near_duplicate_texts(docs, threshold=threshold, sketches=sketches, hot=hot)
    links = found.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    members = text_members(docs)
    classes = members.groupBy("tid").agg(F.min("record_id").alias("class_id"), F.count("*").alias("n"))
    classes = classes.join(links, "tid", "left").where("n > 1 or links is not null").select("tid", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(classes, "tid").select("record_id", "class_id", "links")
