"""Visually identical text with different characters, brought to one form.

Method. The skeleton of a text: decompose canonically, drop characters without
width, replace every character by its prototype from the look-alike table,
decompose again, compose. The table covers full-width and half-width forms,
joined letters, hyphens, spaces of one line, and look-alike letters of Latin,
Greek and Cyrillic. Case, accents, raised and lowered characters, line breaks
and tabs are kept. Texts with equal skeletons look the same.

Scale. Only stretches outside ASCII, each with the character before it, are
decomposed and replaced; a task remembers the form of those it has met. An
ASCII character never joins with what stands before it, so the stretches are
independent of each other. Texts are read once: what is grouped is a table of
ids with a 128-bit digest of the skeleton and one of the text. Pairs are made
of the members of different texts of a group.

Defined cases. The skeleton of a null text is null, of an empty text empty.
Null, empty and blank texts look like nothing in the pairs, and neither do
texts whose skeleton is blank. Equal texts are no pair. Repeated rows (same id
and text) count once. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _cluster

# Letters that look like a Latin one, each with its prototype.
GREEK_CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True))
GREEK_SMALL = dict(zip("ανορυιγ", "avopuiy", strict=True))
CYRILLIC_CAPITALS = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜҮ", "ABESIJKMHOPCTYXGQWY", strict=True))
CYRILLIC_SMALL = dict(zip("асеорхуѕіјһԁԛԝү", "aceopxysijhdqwy", strict=True))
LATIN = dict(zip("ıɑɡſ", "iagf", strict=True))
HYPHENS = "‐‑‒–−⁃˗﹘﹣－֊᠆"
#: Compatibility decompositions that keep the look of a character.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
LIGATURES = range(0xFB00, 0xFB07)


def _no_width(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠㅤ឴឵"


@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str | None]:
    """The translation table, built by rule from the character database and the fixed values."""
    table: dict[int, str | None] = {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if _no_width(c):
            table[i] = None
        elif unicodedata.category(c) == "Zs":
            table[i] = " "
        elif i in LIGATURES:
            table[i] = unicodedata.normalize("NFKD", c)
        elif (d := unicodedata.decomposition(c)) and d.split()[0] in SAME_LOOK:
            table[i] = unicodedata.normalize("NFKD", c)
    for same in (GREEK_CAPITALS, GREEK_SMALL, CYRILLIC_CAPITALS, CYRILLIC_SMALL, LATIN):
        table |= {ord(k): v for k, v in same.items()}
    table |= {ord(c): "-" for c in HYPHENS}
    # A wide form leads to the prototype of its ordinary form.
    return {k: v if v is None else "".join(table.get(ord(x), x) or "" for x in v) for k, v in table.items()}


#: Stretches that need more than a copy, and how many of them a task remembers.
_STRETCH = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_REMEMBERED = 100_000
_known: dict[str, str] = {}


def _form(stretch: str) -> str:
    once = unicodedata.normalize("NFD", stretch).translate(look_alikes())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once).translate(look_alikes()))


def _remembered(match: re.Match) -> str:
    stretch = match[0]
    form = _known.get(stretch)
    if form is None:
        if len(_known) >= _REMEMBERED:
            _known.clear()
        form = _form(stretch)
        if len(stretch) <= 100:
            _known[stretch] = form
    return form


def skeleton(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``."""
    if text is None or text.isascii():
        return text
    return _STRETCH.sub(_remembered, text)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([skeleton(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "skeleton"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        made, look = [_digest(t) for t in texts], []
        for t, d in zip(texts, made, strict=True):
            form = skeleton(t)
            look.append(d if form == t else _digest(form) if form.strip() else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(look, pa.binary()), pa.array(made, pa.binary())], names=["id", "look", "made"])


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_skeleton(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, skeleton) of every row."""
    _cluster.ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_skeletons, f"id {kind}, skeleton string")
    return out.withColumnRenamed("id", id_col)


def look_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(look, made, id): documents whose look is shared by different texts; digests of skeleton and text."""
    _cluster.ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
    made = _cluster.stored(docs.mapInArrow(_digests, f"id {kind}, look binary, made binary").where("look is not null").distinct(), "looks")
    several = made.groupBy("look").agg(F.min("made").alias("lo"), F.max("made").alias("hi")).where("lo != hi").select("look")
    return made.join(several, "look")


def same_look(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_a, doc_b) of documents that look the same but are made of different characters."""
    found = look_groups(df, id_col=id_col, text_col=text_col)
    a = found.select("look", F.col("made").alias("made_a"), F.col("id").alias("doc_a"))
    b = found.select("look", F.col("made").alias("made_b"), F.col("id").alias("doc_b"))
    return a.join(b, "look").where("doc_a < doc_b and made_a != made_b").select("doc_a", "doc_b")
