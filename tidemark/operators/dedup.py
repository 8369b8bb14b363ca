"""Near-duplicate clusters: MinHash, banding, exact verification, components, curation.

Texts of equal comparison form are collapsed first, so a form that a third of
all records share is one entry in every later step; copies join their cluster
by their form, without being compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import CorpusError
from tidemark.functions import text as tx
from tidemark.operators.components import connected_components
from tidemark.operators.lineage import cut, ship
from tidemark.sources.tables import spread

PERMUTATIONS, BANDS, ROWS = 128, 32, 4
THRESHOLD = 0.6
PRIME = np.uint64((1 << 61) - 1)
_LOW = np.uint64((1 << 32) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for x below 2**64."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 without wider integers: 32-bit halves, shifts are rotations modulo the prime."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    high = _reduce(ah * bh)  # times 2**64 = 2**3
    mid = _reduce(_reduce(ah * bl) + _reduce(al * bh))  # times 2**32
    high = _reduce(high << np.uint64(3))
    mid = _reduce((mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    return _reduce(_reduce(high + mid) + _reduce(al * bl))


def sixty_bits(text: str) -> int:
    """The first 15 hexadecimal digits of the MD5 of a text, as a number below the prime."""
    return int(md5(text.encode()).hexdigest()[:15], 16)  # noqa: S324 - a hash, not a secret


@lru_cache(maxsize=4)
def hash_family(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of n affine maps modulo the prime, the same in every process."""
    return np.array([1 + sixty_bits(f"a{i}") for i in range(n)], np.uint64), np.array([sixty_bits(f"b{i}") for i in range(n)], np.uint64)


def gram_hash(gram: Column) -> Column:
    """:func:`sixty_bits` of a gram, as a column."""
    return F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("long")


def signatures_of(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least value of each map over the hashes of each set, shape (sets, maps); the prime itself for an empty set."""
    a, b = hash_family()
    out = np.full((len(size), len(a)), PRIME, np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        start = (np.cumsum(size) - size)[has]
        for i in range(len(a)):
            out[has, i] = np.minimum.reduceat(_reduce(multiply(np.broadcast_to(a[i], hashes.shape), hashes) + b[i]), start)
    return out.astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            grams = part.column(1)
            size = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sig = signatures_of(grams.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), size)
            offsets = pa.array(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], names=["rep", "sig"])


def signatures(sets: DataFrame) -> DataFrame:
    """(rep, sig) of sets (rep, grams), where grams are hashes."""
    ship(sets.sparkSession)
    return spread(sets.select("rep", "grams")).mapInArrow(_signed, "rep long, sig array<long>")


def gram_sets(reps: DataFrame, width: int) -> DataFrame:
    """(rep, grams): the distinct shingles of each form (rep, norm), as 60-bit hashes, a fifth of their size."""
    listed = tx.shingle_list(tx.words(F.col("norm")), width)
    return reps.select("rep", F.array_distinct(F.transform(listed, gram_hash)).alias("grams"))


def forms(records: DataFrame) -> DataFrame:
    """Distinct comparison forms: (norm, rep, copies); rep is the lowest position that has the form."""
    norm = records.select("pos", tx.normalise(F.col("text")).alias("norm"))
    # Filtered behind the aggregation, so that the form is made once for each row.
    return norm.groupBy("norm").agg(F.min("pos").alias("rep"), F.count("*").alias("copies")).where("norm is not null and norm != ''")


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of representatives (rep, sig) that agree in a band."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * ROWS + 1, ROWS)))
    rows = reps.select("rep", F.explode(bands).alias("key"))
    # Buckets of one representative end here, before the self-join.
    several = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")
    left, right = several.withColumnRenamed("rep", "a"), several.withColumnRenamed("rep", "b")
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def jaccard(left: F.Column, right: F.Column) -> F.Column:
    """Exact similarity of two sets; 1 if both are empty."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def compared_pairs(records: DataFrame, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """The sets of the distinct forms, and the candidate pairs that banding makes of them."""
    sets = cut(gram_sets(forms(records), width))  # read four times below
    return sets, candidates(signatures(sets))


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD, width: int = 3) -> DataFrame:
    """Verified pairs of distinct forms: (a, b, similarity), by the lowest position of each form."""
    if not 0 < threshold <= 1:
        raise CorpusError(f"a threshold of {threshold} is not in (0, 1]", "give a similarity above 0, at most 1")
    sets, pairs = compared_pairs(records, width)
    a = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    # Sizes alone rule out most pairs that banding makes by chance.
    smaller, larger = F.least(F.size("ga"), F.size("gb")), F.greatest(F.size("ga"), F.size("gb"))
    possible = pairs.join(a, "a").join(b, "b").where((smaller >= threshold * larger) | (larger == 0))
    return possible.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicate_membership(records: DataFrame, threshold: float = THRESHOLD, width: int = 3) -> DataFrame:
    """(record_id, pos, keep_pos) for the records of clusters of two or more; the lowest position is kept."""
    roots = connected_components(similar_pairs(records, threshold, width).select("a", "b"))
    placed = forms(records).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("norm", F.coalesce("root", "rep").alias("keep_pos"), "copies")
    clusters = placed.groupBy("keep_pos").agg(F.sum("copies").alias("size")).where("size > 1").select("keep_pos")
    members = placed.join(clusters, "keep_pos").select("norm", "keep_pos")
    return records.select("record_id", "pos", tx.normalise(F.col("text")).alias("norm")).join(members, "norm").select("record_id", "pos", "keep_pos", "norm")


def clusters(records: DataFrame, membership: DataFrame, width: int = 3) -> DataFrame:
    """(keep, size, exact, min_similarity): the exact ones equal the kept form; the least similarity to the kept record."""
    kept = membership.where("pos = keep_pos").select("keep_pos", F.col("record_id").alias("keep"), F.col("norm").alias("keep_norm"))
    grams = lambda c: F.transform(tx.shingles(tx.words(F.col(c)), width), lambda g: F.xxhash64(g))
    rows = membership.join(kept, "keep_pos").withColumn("same", F.col("norm") == F.col("keep_norm"))
    score = F.when(F.col("same"), F.lit(1.0)).otherwise(jaccard(grams("norm"), grams("keep_norm")))
    return rows.groupBy("keep").agg(
        F.count("*").alias("size"), (F.count_if("same") - 1).alias("exact"), F.min(score).alias("min_similarity")
    )


def curation_summary(records: DataFrame, cluster_rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row of counters of a curation; with the candidate ``pairs``, also how many were compared."""
    total = records.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    facts = cluster_rows.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    ).withColumn("k", F.lit(1))
    out = total.join(facts, "k").select(
        "k", "total", (F.col("total") - F.col("dropped")).alias("kept"), "dropped", "exact", (F.col("dropped") - F.col("exact")).alias("near"), "clusters", "largest"
    )
    if pairs is not None:
        out = out.join(pairs.agg(F.count("*").alias("comparisons")).withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def cluster_summary(keep: str, size: int, min_similarity: float) -> str:
    """A cluster in a line, its similarity to four digits."""
    return f"{keep}: {size} records, similarity {min_similarity:.4f} or more"


def curated(records: DataFrame, membership: DataFrame) -> DataFrame:
    """The records without the dropped ones of each cluster."""
    return records.join(membership.where("pos != keep_pos").select("record_id"), "record_id", "left_anti")
