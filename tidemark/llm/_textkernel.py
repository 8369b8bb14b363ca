"""Vectorised text kernel shared by the record-level operators.

All functions work on a list of texts at once. Texts are laid out as one array
of code points, so that word boundaries, word hashes and word-triple hashes are
found by array operations instead of a Python loop over words.

A *word* is an unbroken run of letters and digits (``str.isalnum``) in the
lower-case text. The *triples* of a text are its sequences of three
neighbouring words; a text of one or two words has one triple, all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in chunks of about this many characters, which bounds the
#: memory of one call whatever the size of the batch.
CHUNK_CHARS = 1_000_000

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective); spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def _alnum() -> np.ndarray:
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _tables["alnum"]


def _mixed(cp: np.ndarray) -> np.ndarray:
    """:func:`mix` of code points plus one, by a table; a surrogate is a code point too."""
    if "mixed" not in _tables:
        _tables["mixed"] = mix(np.arange(1, 0x110001, dtype=U64))
    return _tables["mixed"][cp]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 of each."""
    if "pow" not in _tables or len(_tables["pow"]) <= n:
        size = max(n + 1, 2 * CHUNK_CHARS)
        base = int(_MULT)
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("pow", base), ("inv", inverse)):
            a = np.full(size, U64(b), U64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"], _tables["inv"]


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Slices of about ``limit`` characters with the index of their first text; null becomes ''."""
    at, chars, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and chars + len(t) > limit:
            yield at, part
            at, chars, part = i, 0, []
        part.append(t)
        chars += len(t)
    if part:
        yield at, part


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets of the texts (one more than texts)."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Prefix sums for substring hashes: see :func:`span_hash`."""
    pw, _ = _powers(len(cp))
    acc = np.zeros(len(cp) + 1, U64)
    np.cumsum(_mixed(cp) * pw[: len(cp)], out=acc[1:])
    return acc


def span_hash(acc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end); equal substrings have equal hashes anywhere."""
    _, inv = _powers(len(acc))
    return mix((acc[end] - acc[start]) * inv[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the offsets of the texts in them."""
    low = [t.lower() for t in texts]
    cp, off = code_points(low)
    if not len(cp):
        return np.empty(0, U64), np.zeros(len(texts) + 1, np.int64)
    is_word = _alnum()[cp]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    first = off[:-1][off[:-1] < len(cp)]
    before[first] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(is_word & ~after) + 1
    return span_hash(prefix_hash(cp), start, end), np.searchsorted(start, off)


def triples(word: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word triples of all texts in text order (repeats kept), and their offsets."""
    n = np.diff(woff)
    toff = np.zeros(len(woff), np.int64)
    np.cumsum(np.where(n > 2, n - 2, np.minimum(n, 1)), out=toff[1:])
    out = np.empty(toff[-1], U64)
    with np.errstate(over="ignore"):
        if len(word) > 2:
            doc = np.repeat(np.arange(len(n)), n)
            t = mix((word[:-2] * U64(0xD6E8FEB86659FD93)) ^ (word[1:-1] * U64(0xA0761D6478BD642F)) ^ (word[2:] * U64(0xE7037ED1A0B428DB)))
            ok = doc[:-2] == doc[2:]
            at = np.arange(len(t)) - woff[doc[:-2]] + toff[doc[:-2]]
            out[at[ok]] = t[ok]
        for k in (1, 2):
            d = np.flatnonzero(n == k)
            h = word[woff[d]] * U64(0x8EBC6AF09C88C6E3)
            if k == 2:
                h ^= word[woff[d] + 1] * U64(0x589965CC75374CC3)
            out[toff[d]] = mix(h + U64(k))
    return out, toff


def owners(off: np.ndarray) -> np.ndarray:
    """The index of the text that each element belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def occurrences(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the same hash came before in the same text: 0 for the first, and so on."""
    key = mix(h + doc.astype(U64) * _MULT)
    # numpy's stable sort is several times slower; only the few repeats need the order of the text.
    order = np.argsort(key)
    k = key[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    out = np.zeros(len(k), np.int64)
    if again.any():
        several = again.copy()
        several[:-1] |= again[1:]
        at, group = order[several], np.cumsum(~again)[several]
        at = at[np.lexsort((at, group))]
        run = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[at] = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return out


def distinct_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct triples of each text: hashes grouped by text, and offsets."""
    h, off = triples(*words(texts))
    doc = owners(off)
    keep = occurrences(h, doc) == 0
    n = np.bincount(doc[keep], minlength=len(texts))
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return h[keep], out


def common_triples(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: distinct triples of the left, of the right, and of both."""
    a, b, c = (np.empty(len(left), np.int64) for _ in range(3))
    # The two sides are chunked together so that long texts stay within bounds.
    both = [(x or "") + "\n" + (y or "") for x, y in zip(left, right, strict=True)]
    for at, part in chunks(both):
        n = len(part)
        ha, oa = distinct_sets([t or "" for t in left[at : at + n]])
        hb, ob = distinct_sets([t or "" for t in right[at : at + n]])
        a[at : at + n], b[at : at + n] = np.diff(oa), np.diff(ob)
        key = np.concatenate([mix(ha + owners(oa).astype(U64) * _MULT), mix(hb + owners(ob).astype(U64) * _MULT)])
        pair = np.concatenate([owners(oa), owners(ob)])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        c[at : at + n] = np.bincount(pair[order][1:][same], minlength=n)
    return a, b, c
