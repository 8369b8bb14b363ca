"""Encoding of whole texts with a public byte-level BPE vocabulary.

Method. A text is cut into words by the vocabulary's pattern, and a word into
segments at every place that no token of the vocabulary spans in it, since
nothing is ever merged across it. Every task has an embedded DuckDB that
encodes its distinct segments by a recursive query: rows of (segment, position,
token) join the merge table; in each step every unfinished segment contracts
its leftmost pair of least rank, and with it the further occurrences of that
pair, as far as the merged token can be part of no pair of lower rank (else
they wait for their own step); a segment without a pair in the table is
finished. The query keeps the last state of a position only, so its memory is
linear in the bytes, whatever the length of a word. An ordered aggregation
gathers the tokens of each segment; texts are put together from their words.
Decoding is a join with the tokens and an ordered aggregation.

Scale. There is no shuffle: documents are encoded where they are read, in
streams of bounded batches. A word is encoded once in a task as long as it
stays in the task's dictionary (``CACHE_WORDS``). The merge table follows from
the vocabulary file, which is read once on the driver and broadcast; its size
is that of the vocabulary. DuckDB runs single-threaded, in memory, on
``CHUNK_BYTES`` bytes of segments at a time, so it never spills to a local disk.

Defined cases. An empty and a null text have no ids (an empty list). Blanks are
tokens like any other. Strings that look like special tokens are ordinary text.
Repeated rows are encoded each. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _cluster
from tidemark.llm import _textkernel as tk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut into words before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_BYTES = 250_000
CACHE_WORDS = 400_000

_ENCODE = """
WITH RECURSIVE step(w, pos, tok, turn) USING KEY (w, pos) AS (
    SELECT w, pos, tok, 0 FROM word
    UNION
    SELECT w, pos, CASE WHEN take THEN merged WHEN NOT eaten THEN tok END, turn + 1
    FROM (
        SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
        FROM (
            -- Of occurrences that overlap, every other one; of a token with pairs of lower rank, the first one.
            SELECT *, hit AND (k - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1 AND (NOT alone OR pos = spot) AS take
            FROM (
                SELECT *, coalesce(merged = least_rank, false) AS hit, min(CASE WHEN merged = least_rank THEN pos END) OVER (PARTITION BY w) AS spot
                FROM (
                    SELECT p.*, m.merged, m.alone, min(m.merged) OVER (PARTITION BY p.w) AS least_rank
                    FROM (
                        SELECT w, pos, tok, turn, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS after, row_number() OVER (PARTITION BY w ORDER BY pos) AS k
                        FROM step WHERE tok IS NOT NULL
                    ) p LEFT JOIN merges m ON p.tok = m.l AND p.after = m.r
                )
                WHERE least_rank IS NOT NULL
            )
        )
    )
)
SELECT w, list(tok ORDER BY pos) AS ids FROM step WHERE tok IS NOT NULL GROUP BY w ORDER BY w
"""


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file."""
    with Path(path).open("rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (left, right, merged, alone): every way to join two tokens to a third, whose rank is the pair's; and the tokens of the 256 bytes.

    ``alone`` is 1 if the merged token is part of a pair of lower rank.
    """
    rows = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left = ranks.get(token[:i])
            right = ranks.get(token[i:]) if left is not None else None
            if right is not None:
                rows.append((left, right, rank))
    merges = np.array(rows, np.int32).reshape(-1, 3)
    lower = np.concatenate([merges[merges[:, 2] < merges[:, i], i] for i in (0, 1)])
    alone = np.isin(merges[:, 2], lower).astype(np.int32)
    return np.column_stack([merges, alone]), np.array([ranks[bytes([b])] for b in range(256)], np.int32)


class Segments:
    """Where words can be cut because no token spans the place."""

    def __init__(self, tokens: list[bytes]) -> None:
        by_size: dict[int, list[bytes]] = {}
        for t in tokens:
            by_size.setdefault(len(t), []).append(t)
        self.hashes: dict[int, np.ndarray] = {}
        for n in sorted(by_size):
            if n > 1:
                at = np.arange(len(by_size[n])) * n
                acc = tk.prefix_hash(np.frombuffer(b"".join(by_size[n]), np.uint8))
                self.hashes[n] = np.sort(tk.span_hash(acc, at, at + n))

    def cut(self, words: list[bytes]) -> list[list[bytes]]:
        """The segments of each word; words are not empty."""
        buf, size = b"".join(words), np.array([len(w) for w in words])
        off = np.concatenate([[0], np.cumsum(size)])
        acc = tk.prefix_hash(np.frombuffer(buf, np.uint8))
        end, pos = np.repeat(off[1:], size), np.arange(len(buf))
        change = np.zeros(len(buf) + 1, np.int64)
        for n, known in self.hashes.items():
            pos = pos[pos + n <= end[pos]]
            if not len(pos):
                break
            h = tk.span_hash(acc, pos, pos + n)
            hit = pos[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            np.add.at(change, hit + 1, 1)
            np.add.at(change, hit + n, -1)
        starts = np.cumsum(change[:-1]) == 0
        starts[off[:-1]] = True
        at = np.flatnonzero(starts)
        parts = [buf[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(buf)], strict=True)]
        first = np.searchsorted(at, off).tolist()
        return [parts[a:b] for a, b in zip(first, first[1:], strict=False)]


class WordEncoder:
    """Encodes words by the recursive query, on an embedded database."""

    def __init__(self, merges: np.ndarray, byte_tokens: np.ndarray, tokens: list[bytes]) -> None:
        import duckdb

        self.byte_tokens, self.segments = byte_tokens, Segments(tokens)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("given", pa.table({"l": merges[:, 0], "r": merges[:, 1], "merged": merges[:, 2], "alone": merges[:, 3] == 1}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word; words are not empty."""
        out: list[list[int]] = []
        for part in _portions([w.encode("utf-8", "surrogatepass") for w in words]):
            cut = self.segments.cut(part)
            new = list({s for ss in cut for s in ss})
            known = dict(zip(new, self._encoded(new), strict=True))
            out += [[i for s in ss for i in known[s]] for ss in cut]
        return out

    def _encoded(self, raw: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in raw])
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        tok = self.byte_tokens[np.frombuffer(b"".join(raw), np.uint8)]
        self.db.register("word", pa.table({"w": w, "pos": pos, "tok": tok}))
        ids = self.db.sql(_ENCODE).to_arrow_table().column("ids").to_pylist()
        self.db.unregister("word")
        return ids


def _portions(words: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    part, size = [], 0
    for w in words:
        if part and size + len(w) > limit:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


def _encoder(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of = regex.compile(PATTERN).findall
        encoder, known = None, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in tk.chunks(texts, 2_000_000):
                encoder = encoder or WordEncoder(*spread.value)
                cut = [words_of(t) for t in part]
                new = list({w for ws in cut for w in ws if w not in known})
                if len(known) + len(new) > CACHE_WORDS:
                    known = {}
                    new = list({w for ws in cut for w in ws})
                known.update(zip(new, encoder.encode(new), strict=True))
                flat = [[i for w in ws for i in known[w]] for ws in cut]
                off = np.zeros(len(flat) + 1, np.int32)
                np.cumsum([len(x) for x in flat], out=off[1:])
                values = np.fromiter((i for x in flat for i in x), np.int32, off[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.ListArray.from_arrays(pa.array(off), pa.array(values))], names=["id", "ids"]
                )

    return run


def token_ids(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row: the token ids of its text."""
    spark = df.sparkSession
    _cluster.ship(spark)
    ranks = read_vocabulary(vocabulary)
    spread = spark.sparkContext.broadcast((*merge_table(ranks), list(ranks)))
    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encoder(spread), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of rows with token ids: tokens joined by rank and gathered in order; no ids give an empty text."""
    spark = df.sparkSession
    _cluster.ship(spark)
    # One row for each token of the vocabulary.
    tokens = spark.createDataFrame([(r, bytearray(t)) for t, r in read_vocabulary(vocabulary).items()], "tok int, bytes binary")
    numbered = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(ids_col).alias("ids"))
    rows = numbered.select("id", "row", F.posexplode_outer("ids").alias("pos", "tok"))
    joined = rows.join(tokens, "tok", "left").groupBy("row").agg(F.any_value("id").alias(id_col), F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    present = F.filter("parts", lambda x: x["bytes"].isNotNull())
    # Hexadecimal digits of the bytes in order; characters may be split between tokens.
    digits = F.array_join(F.transform(present, lambda x: F.hex(x["bytes"])), "")
    kind = dict(df.dtypes)[id_col]
    return joined.select(id_col, F.unhex(digits).alias("raw")).mapInArrow(_as_text, f"{id_col} {kind}, text string")


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[batch.schema.names[0], "text"])
