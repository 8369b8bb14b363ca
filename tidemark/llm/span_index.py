"""Long exact spans shared between records, by a log-structured fingerprint index.

Method. Every stretch of ``length`` characters has an anchor: the least hash of
the ``GRAM``-character grams inside it. Equal stretches have equal anchors, so
only the anchors of a text (about one for 35 characters) are indexed. The index
is log-structured. Each batch of records becomes an immutable run of (anchor,
text) entries sorted by anchor, in blocks of key ranges, and a table of its
texts in compressed blocks; both are written once to the folder of the index.
The new run is merge-joined with the runs of history by key range: anchors of
two or more different texts, one of them new, mark the windows that may be
shared, of new and of historical texts alike. These windows are verified on the
texts themselves, which the index holds, by hashes of all their characters, and
the shared ones are written to the index as intervals. When ``fanout`` runs of
one level have gathered, they are compacted into one run of the next level,
without repeats, and deleted; a later batch then meets one run instead of many.
A list of what belongs to the index stands beside the runs; an index can be
opened again in another session, and a batch whose entry broke off is not in it.

Scale. Texts are entered by a 64-bit hash of the whole text, so copies of a
text, however many, are one text in the index; a text of two or more records is
shared from end to end and needs no windows. A task merges its repeats before
they are sent. Runs and texts are bucketed tables: history is read where it
lies, without an exchange. A batch costs an exchange of its own entries and
texts, and of the anchors and windows that it shares with history. The windows
of one anchor are compared in one task, unless more than ``HOT`` texts have it:
then they are counted by window over all tasks. The entries of one anchor, 14
bytes a text, stand in one bucket. The number of buckets follows the size of
the batches; an index that outgrows it is rewritten with twice as many.

Defined cases. Positions count characters (code points) from 0; the end is
exclusive. Texts shorter than ``length``, null, empty and blank texts have no
spans. A stretch that occurs twice within one record only is not shared.
Repeated rows (same id and text) count as one record. Texts that already are in
the index may come again with a later batch. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _blocks, _cluster, _texts
from tidemark.llm import _textkernel as tk
from tidemark.llm._textkernel import U64
from tidemark.llm._texts import KIND, SCHEMA, identified

GRAM = 32
_FULL = U64(0xFFFFFFFFFFFFFFFF)
_KEY_SHIFT = U64(64 - 8 * _blocks.KEY_BYTES)
#: Bytes of a text's hash in the blocks: all of it.
_TID = 8
#: Kinds of blocks: texts, entries of historical and of new runs, anchors asked for, windows to verify; the latter two also of hot anchors.
TEXT, OLD, NEW, ASKED, ASKED_HOT, WINDOWS, WINDOWS_HOT = range(7)
#: Texts with one anchor whose windows are compared in one task.
HOT = 20_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]), for each full window."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (anchor hash, text index, first window, last window), prefix hashes, offsets.

    Windows are given by their first character in the joined texts.
    """
    cp, off = tk.code_points(texts)
    acc = tk.prefix_hash(cp)
    n = len(cp)
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, U64), none, none, none, acc, off
    _, inv = tk._powers(n)
    gram = (acc[GRAM:] - acc[:-GRAM]) * inv[: n - GRAM + 1]
    least = _sliding_min(gram, length - GRAM + 1)
    # Windows that cross the end of a text are left out.
    size = np.diff(off)
    valid = np.zeros(n - length + 2, np.int32)
    has = np.flatnonzero(size >= length)
    if not len(has):
        return np.empty(0, U64), none, none, none, acc, off
    np.add.at(valid, off[has], 1)
    np.add.at(valid, off[has] + size[has] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    starts = valid.copy()
    starts[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts[off[has]] = True
    first = np.flatnonzero(starts)
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | starts[1:]
    last = np.flatnonzero(stops)
    doc = np.searchsorted(off, first, "right") - 1
    return tk.mix(least[first]), doc, first, last, acc, off


def _run_blocks(key: np.ndarray, tid: np.ndarray, slots: list[int], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of sorted distinct entries."""
    cut = np.searchsorted(_blocks.bucket_of(key, len(slots)), np.arange(len(slots) + 1))
    short = key >> _KEY_SHIFT
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        yield slots[b], kind, _blocks.planes(short[s], _blocks.KEY_BYTES) + _blocks.planes(tid[s], _TID)


def _sorted_entries(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct entries of blocks."""
    width = _blocks.KEY_BYTES + _TID
    parts = [(_blocks.unplanes(x, _blocks.KEY_BYTES, len(x) // width), _blocks.unplanes(x, _TID, len(x) // width, len(x) // width * _blocks.KEY_BYTES)) for x in blobs]
    if not parts:
        return np.empty(0, U64), np.empty(0, U64)
    return _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _distinct(key: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((tid, key))
    key, tid = key[order], tid[order]
    new = np.append(True, (key[1:] != key[:-1]) | (tid[1:] != tid[:-1]))[: len(key)]
    return key[new], tid[new]


def _enter(slots: list[int], length: int):
    """Blocks of the distinct texts of a task and of their (anchor, text) entries."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held: dict[int, str] = {}
        chars = 0

        def flush() -> Iterator[tuple[int, int, bytes]]:
            yield from _texts._by_bucket(held, slots)
            tid, found = np.array(list(held), U64), []
            for at, part in tk.chunks(list(held.values())):
                key, doc, *_ = anchors(part, length)
                found.append((key, tid[at + doc]))
            yield from _run_blocks(*_distinct(*(np.concatenate(x) for x in zip(*found, strict=True))), slots, NEW)

        for batch in batches:
            for t, text in zip(_texts.tids(batch.column(0)).tolist(), batch.column(1).to_pylist(), strict=True):
                if t not in held:
                    held[t] = text
                    chars += len(text)
                    if chars > _texts.FLUSH_CHARS:
                        yield from flush()
                        held, chars = {}, 0
        if held:
            yield from flush()

    return lambda batches: _blocks.rows(items(batches), SCHEMA)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket as it is stored: the entries as one sorted block, the texts as they came."""
    entries, bucket = [], None
    for batch in batches:
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        bucket = batch.column(0)[0].as_py() if len(batch) else bucket
        entries += batch.column(2).filter(pa.array(kinds != TEXT)).to_pylist()
        texts = batch.filter(pa.array(kinds == TEXT))
        if len(texts):
            yield texts
    if entries:
        key, tid = _sorted_entries(entries)
        block = _blocks.planes(key, _blocks.KEY_BYTES) + _blocks.planes(tid, _TID)
        yield from _blocks.rows(iter([(bucket, NEW, block)]), SCHEMA)


def _merge_join(slots: list[int], hot: int):
    """For the buckets of the texts: the anchors that two texts share, one of them new."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        blobs = _texts.by_kind(batches)
        if NEW not in blobs:
            return
        new, _ = _sorted_entries(blobs[NEW])
        key, tid = _sorted_entries(blobs[NEW] + blobs.get(OLD, []))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        fresh = np.isin(key[first], new)
        many = np.repeat(n, n)
        take = np.repeat(fresh & (n > 1), n)
        for kind, of in ((ASKED, take & (many <= hot)), (ASKED_HOT, take & (many > hot))):
            k, t = key[of], tid[of]
            order = np.argsort(t, kind="stable")
            k, t = k[order], t[order]
            cut = np.searchsorted(_blocks.bucket_of(t, len(slots)), np.arange(len(slots) + 1))
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                yield slots[b], kind, _blocks.planes(k[s], _blocks.KEY_BYTES) + _blocks.planes(t[s], _TID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks.rows(items(batches), SCHEMA)

    return run


_CTX = (_blocks.KEY_BYTES, _TID, 4, 2)


def _windows_of(slots: list[int], length: int):
    """From texts and the anchors asked for: blocks of windows to verify, with their characters, for the buckets of the anchors."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        blobs = _texts.by_kind(batches)
        asked = [(_sorted_entries(blobs[k]), k) for k in (ASKED, ASKED_HOT) if k in blobs]
        if not asked:
            return
        here = _texts.Texts(blobs.get(TEXT, []))
        want_key, want_tid = (np.concatenate([x[i] for x, _ in asked]) for i in range(2))
        want_hot = np.concatenate([np.full(len(x[0]), k == ASKED_HOT) for x, k in asked])
        place = here.places(want_tid)
        texts = np.unique(place)
        held: list[tuple] = []
        size = 0
        for lo, part in tk.chunks([here.texts[i] for i in texts.tolist()]):
            key, doc, first, last, _, off = anchors(part, length)
            mine = np.flatnonzero((place >= texts[lo]) & (place <= texts[lo + len(part) - 1]))
            # Membership of (text, anchor) among the wanted ones.
            have = tk.mix((key >> _KEY_SHIFT) + tk.mix((lo + doc).astype(U64)))
            want = tk.mix(want_key[mine] + tk.mix(np.searchsorted(texts, place[mine]).astype(U64)))
            order = np.argsort(want)
            want, is_hot = want[order], want_hot[mine][order]
            at = np.minimum(np.searchsorted(want, have), len(want) - 1)
            hit = np.flatnonzero(want[at] == have)
            start = first[hit] - off[doc[hit]]
            stop = last[hit] - off[doc[hit]] + length
            ctx = np.empty(len(hit), object)
            for i, (d, x, z) in enumerate(zip(doc[hit].tolist(), start.tolist(), stop.tolist(), strict=True)):
                ctx[i] = part[d][x:z]
            tid, hot = here.tid[texts[lo + doc[hit]]], is_hot[at[hit]]
            for h in (False, True):
                m = hot == h
                # Long runs of one anchor (periodic text) go in pieces.
                for k, t, x, c in _pieces(key[hit][m], tid[m], start[m], ctx[m], length):
                    held.append((k, t, x, c, np.full(len(k), h)))
                    size += int(sum(map(len, c)))
            if size > _texts.FLUSH_CHARS:
                yield from _packed_windows(held, slots)
                held, size = [], 0
        if held:
            yield from _packed_windows(held, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks.rows(items(batches), SCHEMA)

    return run


def _packed_windows(held: list[tuple], slots: list[int]) -> Iterator[tuple[int, int, bytes]]:
    key, tid, at, ctx, hot = (np.concatenate(x) for x in zip(*held, strict=True))
    # Windows of hot anchors go anywhere; they are counted by their own hash.
    to = np.where(hot, _blocks.bucket_of(tk.mix(key ^ tid), len(slots)), _blocks.bucket_of(key, len(slots)))
    order = np.lexsort((key, to, hot))
    key, tid, at, ctx, hot, to = (x[order] for x in (key, tid, at, ctx, hot, to))
    new = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (hot[1:] != hot[:-1]))) if len(key) else np.empty(0, np.int64)
    for lo, hi in zip(new.tolist(), np.append(new[1:], len(key)).tolist(), strict=True):
        chars = ctx[lo:hi]
        raw = "".join(chars).encode("utf-8", "surrogatepass")
        columns = (key[lo:hi] >> _KEY_SHIFT, tid[lo:hi], at[lo:hi].astype(U64), np.array([len(c) for c in chars], U64))
        block = np.array([hi - lo, len(raw)], "<u8").tobytes() + b"".join(_blocks.planes(c, w) for c, w in zip(columns, _CTX, strict=True))
        yield slots[int(to[lo])], WINDOWS_HOT if hot[lo] else WINDOWS, block + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpacked_windows(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    n, size = np.frombuffer(block, "<u8", 2).tolist()
    at, cols = 16, []
    for w in _CTX:
        cols.append(_blocks.unplanes(block, w, n, at))
        at += w * n
    text = pa.Codec("zstd").decompress(block[at:], size, asbytes=True).decode("utf-8", "surrogatepass")
    end = np.cumsum(cols[3]).astype(np.int64).tolist()
    return cols[0], cols[1], cols[2].astype(np.int64), [text[x:y] for x, y in zip([0, *end], end, strict=False)]


def _pieces(key: np.ndarray, tid: np.ndarray, at: np.ndarray, ctx: np.ndarray, length: int, most: int = 30_000) -> Iterator[tuple]:
    size = np.array([len(c) for c in ctx], np.int64)
    short = size <= most
    if short.any():
        yield key[short], tid[short], at[short], ctx[short]
    for i in np.flatnonzero(~short):
        a = np.arange(0, size[i] - length + 1, most - length + 1)
        part = np.empty(len(a), object)
        for j, x in enumerate(a.tolist()):
            part[j] = ctx[i][x : x + most]
        yield np.repeat(key[i], len(a)), np.repeat(tid[i], len(a)), at[i] + a, part


def shared_windows(key: np.ndarray, tid: np.ndarray, at: np.ndarray, ctx: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that another text with the same anchor has too, united to runs: (tid, start, end)."""
    none = np.empty(0, np.int64)
    outs: list[tuple[np.ndarray, ...]] = []
    order = np.argsort(key, kind="stable")
    # Chunks end between keys, so that a group stays together.
    key, tid, at = key[order], tid[order], at[order]
    ctx = [ctx[i] for i in order]
    lo = 0
    size = np.cumsum([len(c) for c in ctx]) if ctx else none
    while lo < len(key):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + tk.CHUNK_CHARS, "right")))
        hi = int(np.searchsorted(key, key[hi - 1], "right"))
        outs.append(_windows(key[lo:hi], tid[lo:hi], at[lo:hi], ctx[lo:hi], length))
        lo = hi
    if not outs:
        return np.empty(0, U64), none, none
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _hashed(key: np.ndarray, ctx: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of contexts: hash, context, place in it, place in the joined contexts."""
    cp, off = tk.code_points(ctx)
    acc = tk.prefix_hash(cp)
    count = np.diff(off) - length + 1
    entry = np.repeat(np.arange(len(ctx)), count)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    start = off[entry] + within
    return tk.mix(tk.span_hash(acc, start, start + length) + tk.mix(key)[entry]), entry, within, start


def _windows(key: np.ndarray, tid: np.ndarray, at: np.ndarray, ctx: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, entry, within, _ = _hashed(key, ctx, length)
    order = np.argsort(h, kind="stable")
    hs, ts = h[order], tid[entry[order]]
    new = np.append(True, hs[1:] != hs[:-1])
    run = np.flatnonzero(new)
    # Shared: the least and the greatest text of a run differ.
    differ = np.minimum.reduceat(ts, run) != np.maximum.reduceat(ts, run)
    shared = np.empty(len(h), bool)
    shared[order] = np.repeat(differ, np.diff(np.append(run, len(hs))))
    flag = shared.copy()
    edge = np.append(True, entry[1:] != entry[:-1])
    begin = flag & (edge | ~np.append(False, flag[:-1]))
    finish = flag & (np.append(edge[1:], True) | ~np.append(flag[1:], False))
    b, f = np.flatnonzero(begin), np.flatnonzero(finish)
    e = entry[b]
    return tid[e], at[e] + within[b], at[e] + within[f] + length


def _verify(length: int):
    """Within a bucket: the runs of windows that another text has too."""
    schema = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked_windows(x) for x in _texts.by_kind(batches).get(WINDOWS, ())]
        if not parts:
            return
        key, tid, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        t, s, e = shared_windows(key, tid, at, [c for p in parts for c in p[3]], length)
        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(s), pa.array(e)], schema=schema)

    return run


def _each_window(length: int):
    """The windows of hot anchors one by one: (hash, tid, start)."""
    schema = pa.schema([("hash", pa.int64()), ("tid", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind != WINDOWS_HOT:
                    continue
                key, tid, at, ctx = _unpacked_windows(block)
                for lo, part in tk.chunks(ctx):
                    h, entry, within, _ = _hashed(key[lo : lo + len(part)], part, length)
                    entry += lo
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tid[entry].view(np.int64)), pa.array(at[entry] + within)], schema=schema)

    return run


class SpanIndex:
    """Runs of window anchors and the texts they stand for, in a folder, for deduplication batch by batch.

    ``add`` enters a batch and finds what it shares with all that was entered
    before; ``spans`` has the shared spans of all texts so far. An index in a
    ``folder`` of its own stays and can be opened again; others end with the session.
    """

    def __init__(self, spark: SparkSession, *, folder: str | None = None, length: int = 100, fanout: int = 4, buckets: int | None = None, hot: int = HOT) -> None:
        if length < GRAM:
            raise ValueError(f"a span has at least {GRAM} characters")
        _cluster.ship(spark)
        self.spark, self.fanout, self.hot = spark, fanout, hot
        self.folder = folder or _cluster.passing_folder(spark, "index")
        self.list = {"version": 0, "length": length, "buckets": buckets or 0, "planned": 0, "runs": [], "texts": [], "spans": []}
        self.tables: dict[str, str] = {}
        self.compactions = 0
        found = _cluster.newest(spark, self.folder, "index-")
        if found:
            self.list = json.loads(_cluster.read_text(spark, found))
            if self.list["length"] != length:
                raise ValueError(f"the index is of spans of {self.list['length']} characters")
        self._slots: list[int] = []

    @property
    def slots(self) -> list[int]:
        if len(self._slots) != self.list["buckets"]:
            self._slots = _blocks.slots(self.spark, self.list["buckets"])
        return self._slots

    def _commit(self, **changes: object) -> None:
        """Write the next version of the list; what it no longer names is deleted."""
        before = {x["path"] for k in ("runs", "texts") for x in self.list[k]} | set(self.list["spans"])
        self.list = self.list | changes | {"version": self.list["version"] + 1}
        _cluster.write_text(self.spark, f"{self.folder}/index-{self.list['version']:09d}.json", json.dumps(self.list))
        _cluster.remove(self.spark, f"{self.folder}/index-{self.list['version'] - 1:09d}.json")
        for path in before - {x["path"] for k in ("runs", "texts") for x in self.list[k]} - set(self.list["spans"]):
            if path in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
            _cluster.remove(self.spark, path)

    def _write(self, blocks: DataFrame, kinds: dict[int, str]) -> dict[int, dict]:
        """Blocks (bucket, kind, block), partitioned by bucket, as bucketed tables, one of each kind."""
        n, path, name = self.list["buckets"], f"{self.folder}/{uuid.uuid4().hex}", f"tidemark_{uuid.uuid4().hex}"
        writer = blocks.write.format("parquet").option("compression", "zstd").option("path", path)
        writer.partitionBy("kind").bucketBy(n, "bucket").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return {k: {"path": f"{path}/kind={k}", "buckets": n} for k in kinds if _cluster.exists(self.spark, f"{path}/kind={k}")}

    def _read(self, stored: dict, kind: int) -> DataFrame:
        path = stored["path"]
        if path not in self.tables:
            self.tables[path] = f"tidemark_{uuid.uuid4().hex}"
            clustered = f"CLUSTERED BY (bucket) INTO {stored['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE {self.tables[path]} (bucket INT, block BINARY) USING parquet {clustered} LOCATION '{path}'")
        return self.spark.table(self.tables[path]).select("bucket", F.lit(kind).alias("kind"), "block")

    def _grouped(self, parts: list[DataFrame], function, schema: str = KIND) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy("bucket").applyInArrow(function, schema)

    def _exchanged(self, blocks: DataFrame) -> DataFrame:
        return blocks.repartition(self.list["buckets"], "bucket")

    def add(self, docs: DataFrame) -> None:
        """Enter a batch of (tid, text), find what it shares, and compact where ``fanout`` runs of a level are there."""
        need = max(_blocks.bucket_count(docs, 1 / 35, least=1), _texts.bucket_count(docs, least=1))
        self.list["planned"] += need
        if not self.list["buckets"]:
            self.list["buckets"] = max(need, _blocks.least_buckets(self.spark))
        elif self.list["planned"] > 2 * self.list["buckets"]:
            self._split(2 * self.list["buckets"])
        with _cluster.settings(self.spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            entered = self._exchanged(docs.select("tid", "text").mapInArrow(_enter(self.slots, self.list["length"]), KIND))
            stored = self._write(entered.mapInArrow(_settle, KIND), {TEXT: "texts", NEW: "runs"})
            if NEW not in stored:
                if TEXT in stored:
                    _cluster.remove(self.spark, stored[TEXT]["path"])
                return
            texts = [*self.list["texts"], stored[TEXT]]
            spans = f"{self.folder}/{uuid.uuid4().hex}"
            self._shared(stored[NEW], texts).write.option("compression", "zstd").parquet(spans)
            self._commit(runs=[*self.list["runs"], stored[NEW] | {"level": 0}], texts=texts, spans=[*self.list["spans"], spans])
            self._compact()

    def _shared(self, new: dict, texts: list[dict]) -> DataFrame:
        """Intervals (tid, start, end) that texts of the new run share, and texts of history with them."""
        length = self.list["length"]
        runs = [self._read(r, OLD) for r in self.list["runs"]]
        asked = self._exchanged(self._grouped([self._read(new, NEW), *runs], _merge_join(self.slots, self.hot)))
        windows = self._exchanged(self._grouped([*(self._read(t, TEXT) for t in texts), asked], _windows_of(self.slots, length)))
        kind = "tid long, start long, end long"
        plain = windows.mapInArrow(_verify(length), kind)
        # Of hot anchors: which windows two texts have, counted over all tasks.
        each = windows.where(f"kind = {WINDOWS_HOT}").mapInArrow(_each_window(length), "hash long, tid long, start long")
        several = each.groupBy("hash").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo != hi").select("hash")
        hot = each.join(several, "hash").select("tid", "start", (F.col("start") + length).alias("end"))
        return united(plain.unionByName(hot))

    def _compact(self) -> None:
        while True:
            levels = [r["level"] for r in self.list["runs"]]
            full = next((k for k in sorted(set(levels)) if levels.count(k) >= self.fanout), None)
            if full is None:
                return
            old = [r for r in self.list["runs"] if r["level"] == full]
            merged = self._write(self._grouped([self._read(r, NEW) for r in old], _settle), {NEW: "runs"})
            self._commit(runs=[r for r in self.list["runs"] if r["level"] != full] + [merged[NEW] | {"level": full + 1}])
            self.compactions += 1

    def _split(self, buckets: int) -> None:
        """Rewrite runs and texts for more buckets."""
        old, self.list["buckets"] = {k: [self._read(x, NEW if k == "runs" else TEXT) for x in self.list[k]] for k in ("runs", "texts")}, buckets
        slots = self.slots
        changes: dict[str, list] = {}
        for k, kind in (("runs", NEW), ("texts", TEXT)):
            changes[k] = []
            for df, was in zip(old[k], self.list[k], strict=True):
                moved = self._exchanged(df.mapInArrow(_moved(slots), KIND)).mapInArrow(_settle, KIND)
                changes[k].append(was | self._write(moved, {kind: k})[kind])
        self._commit(buckets=buckets, **changes)

    def close(self) -> None:
        """Forget the tables in the session's catalogue; the files stay."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.popitem()[1]}")

    def spans(self) -> DataFrame:
        """The longest runs (tid, start, end) of shared characters of all texts entered so far."""
        kind = "tid long, start long, end long"
        if not self.list["spans"]:
            return self.spark.createDataFrame([], kind)
        return united(self.spark.read.schema(kind).parquet(*self.list["spans"]))


def _moved(slots: list[int]):
    """The contents of blocks for the buckets they now belong to."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == TEXT:
                    tid, texts = _texts.decode(block)
                    yield from _texts._by_bucket(dict(zip(tid.tolist(), texts, strict=True)), slots)
                else:
                    key, tid = _sorted_entries([block])
                    yield from _run_blocks(key << _KEY_SHIFT, tid, slots, kind)

    return lambda batches: _blocks.rows(items(batches), SCHEMA)


def united(raw: DataFrame) -> DataFrame:
    """Overlapping or adjoining intervals of a text as one: (tid, start, end)."""
    w = Window.partitionBy("tid").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = raw.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    grouped = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("tid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def shared_spans(
    df: DataFrame, *, id_col: str = "record_id", text_col: str = "text", length: int = 100, batches: int = 3, fanout: int = 2, hot: int = HOT
) -> DataFrame:
    """Longest runs of shared characters (record_id, span_start, span_end).

    The table is entered into a new index in ``batches`` batches, as a corpus
    that grows would be; with more of them than ``fanout``, runs are compacted
    on the way.
    """
    docs = identified(df, id_col, text_col).where(F.length("text") >= length)
    index = SpanIndex(df.sparkSession, length=length, fanout=fanout, hot=hot)
    for i in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("record_id", F.lit("batch")), F.lit(batches)) == i))
    spans = index.spans()
    index.close()
    # Texts of several records are shared as a whole.
    owners = docs.select("tid", "record_id", F.length("text").cast("long").alias("size")).distinct()
    copied = owners.groupBy("tid").agg(F.count("*").alias("copies"))
    owners = owners.join(copied, "tid")
    whole = owners.where("copies > 1").select("record_id", F.lit(0).cast("long").alias("span_start"), F.col("size").alias("span_end"))
    part = owners.where("copies = 1").join(spans, "tid").select("record_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return part.unionByName(whole)


def shared_share(spans: DataFrame, df: DataFrame, *, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """How much of each record is shared: (record_id, n_chars, shared_chars); records without a span have 0."""
    total = spans.groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = _texts.present(df, id_col, text_col).select("record_id", F.length("text").cast("long").alias("n_chars")).distinct()
    return docs.join(total, "record_id", "left").select("record_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
