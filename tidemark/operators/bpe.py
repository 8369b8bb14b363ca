"""A byte-pair tokenizer trained on the words of a corpus.

Word counts are one aggregation on the cluster. Merging is a sequential
algorithm over *distinct* words; these stay in one task for each core, all of
which merge the same pair at a time and send each other the changes of pair
counts. The driver gets the merges. Encoding is done per distinct word in Arrow
batches, with a cache in each worker.
"""

from __future__ import annotations

import heapq
import json
import secrets
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from multiprocessing.connection import Client, Connection, Listener
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import TokenizerError
from tidemark.functions import text as tx
from tidemark.operators.lineage import cut, ship
from tidemark.operators.stats import word_frequencies

# Fixed values of the format.
PAD, UNK, END = "<pad>", "<unk>", "</w>"
VERSION = 1
BYTE_TOKENS = [f"<0x{b:02X}>" for b in range(256)]


@dataclass(frozen=True)
class Tokenizer:
    """Merges in order of rank, and the id of every token."""

    merges: list[tuple[str, str]]
    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "ranks", {pair: i for i, pair in enumerate(self.merges)})

    @property
    def digest(self) -> str:
        lines = [f"{a}\t{b}" for a, b in self.merges] + [f"{t}\t{self.vocab[t]}" for t in sorted(self.vocab)]
        return "sha256:" + sha256("\n".join(lines).encode()).hexdigest()

    def pieces(self, word: str) -> list[str]:
        """The word's symbols after merging: always the pair of lowest rank, leftmost first."""
        out, none = [*word, END], len(self.merges)
        ranks = [self.ranks.get(pair, none) for pair in zip(out, out[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del ranks[at]
            # Only the pairs beside the new symbol have changed.
            for i in range(max(at - 1, 0), min(at + 1, len(ranks))):
                ranks[i] = self.ranks.get((out[i], out[i + 1]), none)
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word; a piece that is no token becomes its UTF-8 bytes."""
        out = []
        for piece in self.pieces(word):
            known = self.vocab.get(piece)
            if known is not None:
                out.append(known)
            else:
                out += [self.vocab.get(BYTE_TOKENS[b], self.vocab[UNK]) for b in piece.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in unicodedata.normalize("NFC", text).lower().split() for i in self.word_ids(w)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined, word ends as spaces; byte tokens stay visible, so this may lose text."""
        inverse = {i: t for t, i in self.vocab.items()}
        return "".join(inverse[i] for i in ids).replace(END, " ").strip()

    def save(self, path: str | Path) -> None:
        doc = {"tidemark_tokenizer": VERSION, "digest": self.digest, "merges": [list(m) for m in self.merges], "vocab": self.vocab}
        Path(path).write_text(json.dumps(doc, ensure_ascii=False, sort_keys=True), encoding="utf-8")


def load(path: str | Path) -> Tokenizer:
    """A saved tokenizer; its digest is computed again and compared."""
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
        version, merges, vocab, digest = doc["tidemark_tokenizer"], doc["merges"], doc["vocab"], doc["digest"]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise TokenizerError(f"{path} is no tokenizer: {e}", "train one and save it") from None
    if version > VERSION:
        raise TokenizerError(f"{path} has version {version}; this engine reads {VERSION}", "use a newer engine")
    found = Tokenizer([(a, b) for a, b in merges], vocab)
    if found.digest != digest:
        raise TokenizerError(f"{path} was changed after it was saved", "train it again")
    return found


def _symbols(word: str) -> list[str]:
    return [*word, END]


def _alphabet(chars: set[str]) -> list[str]:
    return sorted({*BYTE_TOKENS, END, *chars})


class _Merges:
    """Symbols by number (the alphabet first), and the merges made of them so far."""

    def __init__(self, alphabet: list[str], vocab_size: int) -> None:
        if not 300 <= vocab_size <= 100_000:
            raise TokenizerError(f"a vocabulary of {vocab_size} is not in 300 to 100000", "choose another size")
        self.budget = vocab_size - 2 - len(alphabet)
        if self.budget < 0:
            raise TokenizerError(f"{len(alphabet)} single characters do not fit into {vocab_size} tokens", "choose a larger vocabulary")
        self.alphabet, self.names = alphabet, [*alphabet]
        self.number = {t: i for i, t in enumerate(alphabet)}
        self.made: list[tuple[int, int, int]] = []

    @property
    def full(self) -> bool:
        return len(self.made) >= self.budget

    def add(self, a: int, b: int) -> int:
        """Note the merge of a and b; the number of what they make, which other symbols may have made before."""
        name = self.names[a] + self.names[b]
        joined = self.number.setdefault(name, len(self.names))
        if joined == len(self.names):
            self.names.append(name)
        self.made.append((a, b, joined))
        return joined

    def tokenizer(self) -> Tokenizer:
        merges = [(self.names[a], self.names[b]) for a, b, _ in self.made]
        vocab = {PAD: 0, UNK: 1}
        for t in [*self.alphabet, *(a + b for a, b in merges)]:
            vocab.setdefault(t, len(vocab))
        return Tokenizer(merges, vocab)


class _Chain:
    """The symbols of many words in flat arrays, linked within each word, so that a merge changes only where its pair stands."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        self.symbols = np.array(symbols, np.int32)
        at = np.arange(len(symbols), dtype=np.int32)
        self.after, self.before = at + 1, at - 1
        sizes = sizes[sizes > 0]
        ends = np.cumsum(sizes)
        self.after[ends - 1] = -1
        self.before[ends - sizes] = -1

    def merge(self, a: int, b: int, joined: int, note: Callable[[np.ndarray, int], None] | None = None) -> None:
        """Merge a pair everywhere, leftmost first. ``note`` is told the cells whose pairs with the next one go (-1) and come (1)."""
        left = np.flatnonzero(self.symbols == a)
        right = self.after[left]
        hit = (right >= 0) & (self.symbols[right] == b)
        left, right = left[hit], right[hit]
        if a == b and len(left):
            # Of a run of equal symbols every other one begins a merge.
            first = np.flatnonzero(np.append(True, left[1:] != right[:-1]))
            keep = (np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))) % 2 == 0
            left, right = left[keep], right[keep]
        if not len(left):
            return
        if note:
            note(np.concatenate([self.before[left], left, right]), -1)
        then = self.after[right]
        self.symbols[left], self.symbols[right] = joined, -1
        self.after[right] = -1
        self.after[left] = then
        self.before[then[then >= 0]] = left[then >= 0]
        if note:
            note(np.concatenate([self.before[left], left]), 1)

    def pairs(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that have a next one, each once, and the codes of their pairs."""
        cells = np.unique(cells[cells >= 0])
        cells = cells[self.after[cells] >= 0]
        return cells, self.symbols[cells].astype(np.int64) << 32 | self.symbols[self.after[cells]]


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    known, which = np.unique(codes, return_inverse=True)
    return known.tolist(), np.bincount(which, n, len(known)).astype(np.int64).tolist()


def _merge(symbols: np.ndarray, sizes: np.ndarray, n: np.ndarray, merges: _Merges, everywhere: Callable[[dict[int, int]], dict[int, int]] = lambda changed: changed) -> None:
    """Merge the most frequent pair (of equal ones the greatest) until the vocabulary is full or no pair occurs twice.

    Where the words are shared among tasks, ``everywhere`` adds up the changes of
    all; then each task has the counts of all words, and merges the same pairs.
    """
    chain = _Chain(symbols, sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    counts: Counter = Counter()
    changed: dict[int, int] = {}

    def note(cells: np.ndarray, sign: int) -> None:
        cells, codes = chain.pairs(cells)
        for code, c in zip(*_summed(codes, n[owner[cells]]), strict=True):
            changed[code] = changed.get(code, 0) + sign * c

    # Entries are checked against the present count when they come up.
    heap: list[tuple[int, _Greatest, int]] = []

    def settle() -> None:
        for code, c in everywhere(changed).items():
            if c:
                counts[code] += c
                if counts[code] >= 2:
                    heapq.heappush(heap, (-counts[code], _Greatest((merges.names[code >> 32], merges.names[code & 0xFFFFFFFF])), code))
        changed.clear()

    for at in range(0, len(chain.symbols), 500_000):
        note(np.arange(at, min(at + 500_000, len(chain.symbols))), 1)
    settle()
    while heap and not merges.full:
        negative, _, code = heapq.heappop(heap)
        if counts[code] != -negative:
            continue
        a, b = code >> 32, code & 0xFFFFFFFF
        chain.merge(a, b, merges.add(a, b), note)
        settle()


def train_words(counts: dict[str, int], vocab_size: int = 4096) -> Tokenizer:
    """Merge the most frequent pair (of equal ones the greatest) until the vocabulary is full or no pair occurs twice."""
    merges = _Merges(_alphabet({c for w in counts for c in w}), vocab_size)
    symbols, sizes = _Spelling(merges).flat(list(counts))
    _merge(symbols, sizes, np.array(list(counts.values()), np.int64), merges)
    return merges.tokenizer()


class _Spelling:
    """The numbers of single characters, which a task needs to spell words."""

    def __init__(self, merges: _Merges) -> None:
        single = [(ord(t), i) for t, i in merges.number.items() if len(t) == 1]
        self.points, self.numbers = (np.array(x, np.int64) for x in zip(*sorted(single), strict=True)) if single else (np.zeros(0, np.int64),) * 2
        self.end = merges.number[END]

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the characters of each word and of its end mark, and how many there are."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        out = np.full(sizes.sum(), self.end, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = self.numbers[np.searchsorted(self.points, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))] if inner.any() else 0
        return out, sizes


def _linked(context: BarrierTaskContext, key: bytes) -> list[Connection]:
    """Connections of the first task to all others, and of each other one to the first; the tasks' own gathering takes a second a time."""
    if context.partitionId() == 0:
        with Listener(("", 0), backlog=len(context.getTaskInfos()), authkey=key) as listener:
            context.allGather(str(listener.address[1]))
            return [listener.accept() for _ in context.getTaskInfos()[1:]]
    port = int(context.allGather("")[0])
    return [Client((context.getTaskInfos()[0].address.rpartition(":")[0], port), authkey=key)]


def _added_up(first: bool, links: list[Connection]) -> Callable[[dict[int, int]], dict[int, int]]:
    """The sum of the changes of all tasks, which the first one makes."""

    def packed(changed: dict[int, int]) -> bytes:
        return np.array([list(changed.keys()), list(changed.values())], np.int64).tobytes()

    def unpacked(sent: bytes) -> Iterator[tuple[int, int]]:
        return zip(*np.frombuffer(sent, np.int64).reshape(2, -1).tolist(), strict=True)

    def everywhere(changed: dict[int, int]) -> dict[int, int]:
        if not first:
            links[0].send_bytes(packed(changed))
            return dict(unpacked(links[0].recv_bytes()))
        total = Counter(changed)
        for link in links:
            for code, c in unpacked(link.recv_bytes()):
                total[code] += c
        sent = packed(total)
        for link in links:
            link.send_bytes(sent)
        return total

    return everywhere


def _shared(merges: _Merges) -> Callable:
    """All merges, from the first task, of words (word, n) of which each task holds a share."""
    spelling, key = _Spelling(merges), secrets.token_bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        flat, n = [spelling.flat([])], [np.zeros(0, np.int64)]
        for batch in batches:
            flat.append(spelling.flat(batch.column(0).to_pylist()))
            n.append(batch.column(1).to_numpy())
        symbols, sizes = (np.concatenate(x) for x in zip(*flat, strict=True))
        flat.clear()
        first, links = context.partitionId() == 0, _linked(context, key)
        _merge(symbols, sizes, np.concatenate(n), merges, _added_up(first, links))
        for link in links:
            link.close()
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in merges.made], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _train(words: DataFrame, chars: set[str], vocab_size: int) -> Tokenizer:
    """The merges of words (word, n): one task for each core holds its share of them, in 16 bytes a symbol."""
    ship(words.sparkSession)
    merges = _Merges(_alphabet(chars), vocab_size)
    sc = words.sparkSession.sparkContext._jsc.sc()
    slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    for r in words.select("word", "n").repartition(slots, "word").mapInArrow(_shared(merges), "a long, b long", barrier=True).collect():
        merges.add(r["a"], r["b"])
    return merges.tokenizer()


class _Greatest:
    """Orders pairs the other way round in a heap."""

    __slots__ = ("pair",)

    def __init__(self, pair: tuple[str, str]) -> None:
        self.pair = pair

    def __lt__(self, other: _Greatest) -> bool:
        return self.pair > other.pair


def _joined(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def train(records: DataFrame, *, vocab_size: int = 4096) -> Tokenizer:
    """A tokenizer of the records' texts."""
    return train_with_report(records, vocab_size=vocab_size)[0]


@dataclass(frozen=True)
class TrainingReport:
    """What a training run was made of."""

    vocab: int
    merges: int
    distinct_words: int
    words: int
    alphabet: int
    unfilled: int

    def as_dict(self) -> dict[str, int]:
        return dict(self.__dict__)

    def summary(self) -> str:
        short = f", {self.unfilled} places left unfilled" if self.unfilled else ""
        return f"{self.vocab} tokens: {self.alphabet} single ones and {self.merges} merges, from {self.words} words ({self.distinct_words} distinct){short}"


def train_with_report(records: DataFrame, *, vocab_size: int = 4096) -> tuple[Tokenizer, TrainingReport]:
    words = cut(word_frequencies(records.select(tx.nfc(F.col("text")).alias("text"))))
    chars = {r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()} - {""}
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tok = _train(words, chars, vocab_size)
    return tok, TrainingReport(len(tok.vocab), len(tok.merges), distinct, total, len(_alphabet(chars)), vocab_size - len(tok.vocab))


def first_pair(records: DataFrame) -> DataFrame:
    """The counts that decide the first merge: (a, b, n), most frequent first, of equal ones the greatest."""
    chars = F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit(END)))
    listed = word_frequencies(records).select("n", chars.alias("s"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.get("s", i - 1).alias("a"), F.get("s", i).alias("b"))))
    return listed.select("n", pair.alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def encoder(tokenizer: Tokenizer, most: int = 100_000) -> Callable[[str | None], list[int]]:
    """The ids of a text, none for a null one; those of up to ``most`` words are kept at a time."""
    known: dict[str, list[int]] = {}

    def ids(text: str | None) -> list[int]:
        out: list[int] = []
        for w in unicodedata.normalize("NFC", text).lower().split() if text is not None else ():
            if w not in known:
                if len(known) >= most:
                    known.clear()
                known[w] = tokenizer.word_ids(w)
            out += known[w]
        return out

    return ids


def encode(records: DataFrame, tokenizer: Tokenizer, id_col: str = "record_id") -> DataFrame:
    """(record_id, ids) of every record; a null text has no ids."""
    ship(records.sparkSession)
    spread = records.sparkSession.sparkContext.broadcast(tokenizer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(spread.value)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "ids": [ids(text) for text in frame["text"]]})

    kind = dict(records.dtypes)[id_col]
    return records.select(F.col(id_col).alias("id"), "text").mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def compression(records: DataFrame, encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """One row: records, tokens, words, characters of words, unknown tokens, and their ratios."""
    pre = tx.pre_tokens(tx.nfc(F.col("text")))
    sizes = records.select("record_id", F.size(pre).alias("w"), F.aggregate(pre, F.lit(0), lambda a, x: a + F.length(x)).alias("c"))
    unknown = F.size(F.filter("ids", lambda i: i == tokenizer.vocab[UNK]))
    one = (
        encoded.select("record_id", F.size("ids").alias("t"), unknown.alias("u"))
        .join(sizes, "record_id")
        .agg(
            F.count("*").alias("records"), F.sum("t").alias("tokens"), F.sum("w").alias("words"), F.sum("c").alias("characters"), F.sum("u").alias("unknown")
        )
    )
    return one.withColumn("tokens_per_record", F.col("tokens") / F.col("records")).withColumn("tokens_per_word", F.col("tokens") / F.col("words")).withColumn(
        "characters_per_token", F.col("characters") / F.col("tokens")
    )


def train_by_recount(counts: dict[str, int], vocab_size: int) -> Tokenizer:
    """The slow way, which counts all pairs again for every merge; the test of the fast one."""
    words = [(_symbols(w), n) for w, n in counts.items()]
    alphabet = sorted({*BYTE_TOKENS, END, *(c for w in counts for c in w)})
    merges: list[tuple[str, str]] = []
    while len(merges) < vocab_size - 2 - len(alphabet):
        pairs: Counter = Counter()
        for s, n in words:
            for p in zip(s, s[1:], strict=False):
                pairs[p] += n
        if not pairs or max(pairs.values()) < 2:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        merges.append(best)
        words = [(_joined(s, best), n) for s, n in words]
    vocab = {PAD: 0, UNK: 1}
    for t in [*alphabet, *(a + b for a, b in merges)]:
        vocab.setdefault(t, len(vocab))
    return Tokenizer(merges, vocab)
