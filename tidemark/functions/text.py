"""Text functions as Spark columns; all but NFC stay inside generated code.

There are two normal forms. The comparison form (``normalise``) has no
punctuation but hyphen and underscore; the token form (``pre_tokens``) keeps
all of it. Texts are expected in NFC; ``nfc`` brings them there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it."""
    return _nfc(text)


def in_nfc(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their text in NFC, before any of the functions below."""
    return rows.withColumn(text_col, nfc(F.col(text_col)))


def normalise(text: Column) -> Column:
    """Comparison form: lower case, runs of other characters than letters, digits, ``_`` and ``-`` as one space."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def clean(text: Column) -> Column:
    """Stored form: white space runs as one space; case and punctuation stay."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(normal: Column) -> Column:
    """Words of a comparison form; none for an empty text."""
    return _bound(normal, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def pre_tokens(text: Column) -> Column:
    """Token form: lower-case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` evaluated once.

    Inside a lambda an expression is evaluated for each element; a lambda
    variable is not. So the value becomes the variable of an outer lambda.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _windows(w: Column, width: int) -> Column:
    n = F.size(w)
    made = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(n >= width, made).otherwise(F.array().cast("array<string>"))


def windows(tokens: Column, width: int) -> Column:
    """All windows of ``width`` words joined by spaces, repeats kept; none for fewer words."""
    return _bound(tokens, lambda w: _windows(w, width))


def shingle_list(tokens: Column, width: int = 3) -> Column:
    """Windows, or the whole text where it has no more than ``width`` words; nothing for no words."""

    def listed(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) > width, _windows(w, width)).otherwise(whole)

    return _bound(tokens, listed)


def shingles(tokens: Column, width: int = 3) -> Column:
    """Set of shingles."""
    return F.array_distinct(shingle_list(tokens, width))


def ngrams(tokens: Column, width: int = 13) -> Column:
    """Set of n-grams; empty for a text of fewer words, never the whole text."""
    return F.array_distinct(windows(tokens, width))


def fingerprint(label: Column, text: Column) -> Column:
    """Content address of a record: the first 32 hex digits of SHA-256 over label, unit separator and text."""
    return F.substring(F.sha2(F.concat(label.cast("string"), F.lit("\x1f"), text), 256), 1, 32)


def excerpt(text: Column, length: int = 120) -> Column:
    return F.substring(text, 1, length)


def gram_key(gram: Column) -> Column:
    """128 bits that stand for a gram in joins and aggregations, a fifth of its size."""
    return F.struct(F.xxhash64(gram).alias("a"), F.xxhash64(F.lit(17), gram).alias("b"))
