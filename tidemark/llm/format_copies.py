"""Records that differ only in formatting, collapsed to one record each and counted.

Method. Every text has canonical bytes: its letters and digits in lower case,
in order; for a text of labelled fields, the fields by name with the letters
and digits of their contents, so that their order, layout (pairs by colon,
equals sign or dash, one to a line, or a JSON object) and surrounding marks do
not matter. Each task first merges equal canonical bytes of its own. What is
left is partitioned recursively by the leading bytes: a bucket with more than
``bucket_rows`` entries is split by further bytes until each fits (or holds one
value only). A bucket is split behind the bytes that all of its values have in
common, and each round takes twice as many bytes as the last, so the rounds
grow with the logarithm of the longest value at most. Each bucket is counted in
a burst trie with terminal counters, whose containers split by one byte when
they grow. Labelled texts are also compared by their plain letters and digits:
where these are the same as those of an ordinary text, or of other fields, the
two sets of copies are one.

Scale. Only merged entries are shuffled, so a group of copies, however large,
sends a few rows of each task; its members are given their kept record by a
join on a 128-bit digest of the canonical bytes, whose hot keys adaptive
execution may split. A round reads the entries of oversized buckets only and
writes them to the shared folder. The oversized prefixes, at most (entries /
bucket_rows) of them, stay in a table; the driver sees none.

Defined cases. Null, empty and blank texts, and texts without a letter or
digit, are copies of nothing. Equal texts are copies. Repeated rows (same id
and text) are one record. A field name that occurs twice keeps both contents.
A text with fewer than two labels, or with letters or digits before the first
one, is ordinary text. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _cluster
from tidemark.llm import _textkernel as tk
from tidemark.llm.grouped_split import components
from tidemark.llm._texts import present

#: The field names of this project's write-ups; a parameter of the operator.
FIELDS = ("defect", "action", "removed", "fitted", "station", "order", "found by", "stock", "remark", "note")
BUCKET_ROWS = 50_000
#: Bytes that the first round of partitioning looks at.
STEP = 4


def letters_and_digits(texts: list[str]) -> list[str]:
    """The letters and digits of each text in lower case, in order."""
    cp, off = tk.code_points([t.lower() for t in texts])
    keep = tk._alnum()[cp]
    kept = cp[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    end = np.concatenate([[0], np.cumsum(keep)])[off].tolist()
    return [kept[a:b] for a, b in zip(end, end[1:], strict=False)]


def label_pattern(fields: tuple[str, ...]) -> re.Pattern:
    """A label with its separator, not inside a word."""
    names = "|".join(re.escape(f).replace(r"\ ", r"[\s_]+") for f in sorted(fields, key=len, reverse=True))
    return re.compile(rf"(?<![^\W_])({names})[\"'*]*(?:\s*[:=]|\s+[-–—]\s)", re.IGNORECASE)


def canonical(texts: list[str], pattern: re.Pattern) -> list[tuple[bytes, bytes | None]]:
    """Canonical bytes of each text, empty where there is neither letter nor digit, and the plain ones of labelled texts."""
    pieces: list[str] = []
    shape: list[tuple[int, int]] = []  # first piece, number of fields (0: ordinary text)
    for t in texts:
        found = list(pattern.finditer(t))
        if len(found) > 1 and not any(c.isalnum() for c in t[: found[0].start()]):
            shape.append((len(pieces), len(found)))
            for m, after in zip(found, [*found[1:], None], strict=True):
                pieces += [m[1], t[m.end() : after.start() if after else len(t)]]
            pieces.append(t)
        else:
            shape.append((len(pieces), 0))
            pieces.append(t)
    clean = letters_and_digits(pieces)
    out = []
    for first, n in shape:
        if n:
            pairs = sorted(f"{clean[first + 2 * i]}={clean[first + 2 * i + 1]}" for i in range(n))
            out.append(("\x1f".join(pairs).encode("utf-8", "surrogatepass"), clean[first + 2 * n].encode("utf-8", "surrogatepass")))
        else:
            out.append((clean[first].encode("utf-8", "surrogatepass"), None))
    return out


def _digest(canon: bytes) -> bytes:
    return blake2b(canon, digest_size=16).digest()


def _enter(fields: tuple[str, ...], flush_bytes: int = 48_000_000):
    """Rows of two kinds: each record with its digest; each canonical value of the task with its least record id.

    The latter have the digest of the plain form, too, if they are labelled.
    """
    schema = pa.schema([("record_id", pa.string()), ("digest", pa.binary()), ("plain", pa.binary()), ("canon", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = label_pattern(fields)
        seen: dict[tuple[bytes, bytes | None], list] = {}
        size = 0

        def merged() -> pa.RecordBatch:
            items = [(c, v) for (c, _), v in seen.items()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([v[1] for _, v in items], pa.string()),
                    pa.array([v[2] for _, v in items], pa.binary()),
                    pa.array([v[3] for _, v in items], pa.binary()),
                    pa.array([k for k, _ in items], pa.binary()),
                    pa.array([v[0] for _, v in items], pa.int64()),
                ],
                schema=schema,
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in tk.chunks(texts):
                out_ids, out_digests = [], []
                for rid, c in zip(ids[at : at + len(part)], canonical(part, pattern), strict=True):
                    if not c[0]:
                        continue
                    have = seen.get(c)
                    if have is None:
                        seen[c] = have = [0, rid, _digest(c[0]), _digest(c[1]) if c[1] else None]
                        size += 2 * len(c[0]) + 250
                    have[0] += 1
                    if rid < have[1]:
                        have[1] = rid
                    out_ids.append(rid)
                    out_digests.append(have[2])
                nothing = pa.nulls(len(out_ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_ids, pa.string()), pa.array(out_digests, pa.binary()), nothing.cast(pa.binary()), nothing.cast(pa.binary()), nothing.cast(pa.int64())],
                    schema=schema,
                )
                if size > flush_bytes:
                    yield merged()
                    seen, size = {}, 0
        if seen:
            yield merged()

    return run


class BurstTrie:
    """A trie over byte strings with terminal counters; small subtries are containers (dicts of suffixes)."""

    def __init__(self, limit: int = 4096) -> None:
        self.limit, self.root = limit, {}

    def add(self, key: bytes, n: int, least: str, digest: bytes) -> None:
        node, depth = self.root, 0
        while isinstance(node, list):  # an inner node: terminal container, then children by byte
            if depth == len(key):
                node = node[256]
                break
            child = node[key[depth]]
            if child is None:
                child = node[key[depth]] = {}
            depth += 1
            node = child
        rest = key[depth:]
        entry = node.get(rest)
        if entry is None:
            node[rest] = [n, least, digest]
            if len(node) > self.limit:
                self._burst(key[:depth], node)
        else:
            entry[0] += n
            entry[1] = min(entry[1], least)

    def _burst(self, path: bytes, container: dict) -> None:
        inner: list = [None] * 256 + [{}]
        for rest, entry in container.items():
            if not rest:
                inner[256][rest] = entry
                continue
            if inner[rest[0]] is None:
                inner[rest[0]] = {}
            inner[rest[0]][rest[1:]] = entry
        if not path:
            self.root = inner
            return
        node = self.root
        for b in path[:-1]:
            node = node[b]
        node[path[-1]] = inner

    def terminals(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [x for x in node if x is not None]
            else:
                yield from node.values()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; one trie at a time. Values of two or more records come out."""
    schema = pa.schema([("digest", pa.binary()), ("kept", pa.string())])

    def out(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        found = [e for e in trie.terminals() if e[0] > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([e[2] for e in found], pa.binary()), pa.array([e[1] for e in found])], schema=schema)

    trie, current = BurstTrie(), None
    for batch in batches:
        for bucket, canon, n, rid, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current:
                yield from out(trie)
                trie, current = BurstTrie(), bucket
            trie.add(canon[len(bucket) :], n, rid, digest)
    yield from out(trie)


def _next_depth(step: int):
    """The depth at which to split a bucket: ``step`` bytes behind what its least and greatest value have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = [len(commonprefix(pair)) + step for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth, pa.int32())], names=["bucket", "depth"])

    return run


def radix_buckets(entries: DataFrame, bucket_rows: int, step: int = STEP) -> tuple[DataFrame, int]:
    """``entries`` with a column ``bucket``, the leading bytes of ``canon``, more of them where a bucket is too large; and the number of rounds."""
    left, done, rounds = entries.withColumn("depth", F.lit(step)), [], 0
    while True:
        keyed = left.withColumn("bucket", F.expr("substring(canon, 1, depth)"))
        h = F.xxhash64("canon")
        counts = keyed.groupBy("bucket").agg(F.count("*").alias("rows"), F.min(h).alias("lo"), F.max(h).alias("hi"))
        # At most (entries / bucket_rows) of them. A bucket of one value is as small as it gets.
        large = _cluster.stored(counts.where(f"rows > {bucket_rows} and lo != hi").select("bucket"), "large")
        if large.isEmpty():
            done.append(keyed)
            return reduce(DataFrame.unionByName, (d.drop("depth") for d in done)), rounds
        rounds, step = rounds + 1, 2 * step
        done.append(keyed.join(large, "bucket", "left_anti"))
        split = keyed.drop("depth").join(large, "bucket", "left_semi")
        ends = split.groupBy("bucket").agg(F.min("canon").alias("first"), F.max("canon").alias("last"))
        # Both tables are written, so that their size decides whether they are broadcast.
        deeper = _cluster.stored(ends.mapInArrow(_next_depth(step), "bucket binary, depth int"), "deeper")
        left = _cluster.stored(split.join(deeper, "bucket").drop("bucket"), "oversized")


def _linked(entered: DataFrame) -> DataFrame:
    """(digest, label) of the canonical values that are one set by their plain letters and digits; usually none."""
    forms = entered.where("canon is not null").select("digest", F.coalesce("plain", "digest").alias("plain")).distinct()
    several = forms.groupBy("plain").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("plain")
    edges = _cluster.stored(forms.join(several, "plain").select(F.col("digest").alias("node"), F.col("plain").alias("entity")), "links")
    return components(edges).select(F.col("node").alias("digest"), "label").distinct()


def format_copies(
    df: DataFrame, *, id_col: str = "record_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row for each copy: (record_kept, record_copy); the kept record has the least id of its copies."""
    _cluster.ship(df.sparkSession)
    docs = present(df, id_col, text_col)
    entered = _cluster.stored(docs.mapInArrow(_enter(fields), "record_id string, digest binary, plain binary, canon binary, n long"), "canonical")
    entries, _ = radix_buckets(entered.where("canon is not null").select("canon", "n", "record_id", "digest"), bucket_rows)
    terminals = (
        entries.select("bucket", "canon", "n", "record_id", "digest")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_count, "digest binary, kept string")
    )
    members = entered.where("canon is null").select("record_id", "digest")
    kept = members.join(terminals, "digest").select("record_id", "kept", "digest")
    linked = _linked(entered)
    if not linked.isEmpty():
        own = members.join(linked, "digest")
        least = own.groupBy("label").agg(F.min("record_id").alias("kept"))
        kept = kept.join(linked, "digest", "left_anti").select("record_id", "kept").unionByName(own.join(least, "label").select("record_id", "kept"))
    return kept.where("record_id > kept").select(F.col("kept").alias("record_kept"), F.col("record_id").alias("record_copy")).distinct()


def copy_counts(copies: DataFrame) -> DataFrame:
    """(record_kept, copies): how many other records each kept record stands for."""
    return copies.groupBy("record_kept").agg(F.count("*").alias("copies"))
