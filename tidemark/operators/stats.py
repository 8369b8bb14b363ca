"""Statistics of a corpus of records (record_id, text, label, source, license, meta, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.lineage import cut


def label_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("label").agg(F.count("*").alias("records"))


def distinct_values(records: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column, as one row."""
    return records.agg(F.array_sort(F.collect_set(column)).alias(column + "s"))


def duplicate_ids(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Ids that occur more than once, which a corpus must not have."""
    return records.groupBy(id_col).agg(F.count("*").alias("rows")).where("rows > 1")


def corpus_digest(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Content address of a set of records, whatever their order; for each group of ``by`` if given.

    The fingerprints of a corpus file are gathered and sorted, as its format
    demands: 33 bytes a record, for corpora of the size of files. Larger ones
    have :func:`range_digest`.
    """
    prints = records.select(*(by or []), tx.fingerprint(F.col("label"), F.col("text")).alias("fp"))
    joined = F.array_join(F.array_sort(F.collect_list("fp")), "\n")
    return prints.groupBy(*(by or [])).agg(F.count("*").alias("records"), F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("digest"))


def range_digest(rows: DataFrame, line: Column, by: list[str] | None = None, ranges: int = 4096) -> DataFrame:
    """Content address of a set of lines of any size: the digest of the digests of their hash ranges, each sorted by itself.

    It differs from that of a file, but is as independent of the rows' order.
    """
    keys = by or []
    lines = rows.select(*keys, line.alias("line")).withColumn("range", F.pmod(F.xxhash64("line"), F.lit(ranges)))
    one = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
    within = lines.groupBy(*keys, "range").agg(F.count("*").alias("n"), one.alias("d"))
    # At most ``ranges`` rows for each group from here on.
    both = F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("range").cast("string"), 8, "0"), F.col("d")))), "\n")
    return within.groupBy(*keys).agg(F.sum("n").alias("records"), F.concat(F.lit("ranges:"), F.sha2(both, 256)).alias("digest"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The element of index n // 2 in sorted order, found by counts of the distinct values instead of a sort of all rows."""
    return nearest_rank(values, column, 0.5)


def nearest_rank(values: DataFrame, column: str, q: float, out: str = "value") -> DataFrame:
    """sorted[min(int(q * n), n - 1)] of the non-null values, as one row; no row for none.

    Equal values are counted first. Their order is found in slices: the values
    are ranged over tasks, each task adds up its own, and only the sums of the
    tasks are put in one place.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    sliced = counts.repartitionByRange("v").withColumn("slice", F.spark_partition_id())
    sliced = cut(sliced)  # the same slices for all that follows
    slices = sliced.groupBy("slice").agg(F.sum("c").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slices.select("slice", "s", before.alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))
    target = F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    # One slice holds the rank.
    at = placed.withColumn("target", target).where((F.col("before") <= F.col("target")) & (F.col("target") < F.col("before") + F.col("s")))
    within = sliced.join(F.broadcast(at), "slice").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return within.where(F.col("upto") > F.col("target")).agg(F.min("v").alias(out))


def data_card(records: DataFrame) -> DataFrame:
    """One row of facts about the corpus."""
    n_words = tx.word_count(F.col("text"))
    # Distinct texts are counted by a hash of 128 bits, so that the rows that are expanded hold no text.
    mark = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(17), "text").alias("y")))
    flat = records.select("label", "source", "license", mark.alias("text"), n_words.alias("words"))
    by_label = label_counts(records).agg(F.count("*").alias("classes"), F.max("records").alias("majority"))
    facts = flat.agg(
        F.count("*").alias("records"),
        F.count_distinct("text").alias("distinct_texts"),
        F.count_distinct("license").alias("licenses"),
        F.count_distinct("source").alias("sources"),
        F.min("words").alias("words_min"),
        F.max("words").alias("words_max"),
        F.count_if(F.col("text").isNull()).alias("null_texts"),
    )
    median = upper_median(flat, "words").withColumnRenamed("value", "words_median")
    one = facts.withColumn("k", F.lit(1)).join(by_label.withColumn("k", F.lit(1)), "k")
    one = one.join(median.withColumn("k", F.lit(1)), "k", "left")
    return one.select(
        "records", "distinct_texts", "classes", (F.col("majority") / F.col("records")).alias("majority_share"),
        "licenses", "sources", "words_min", "words_median", "words_max", "null_texts",
    )


def label_noise_ceiling(records: DataFrame) -> DataFrame:
    """The accuracy that perfect predictions would reach: 1 less the share of records with a known wrong label; null if none is known."""
    wrong = F.count_if(F.col("meta")["true_label"] != "")
    return records.agg(F.when(wrong > 0, 1 - wrong / F.count("*")).alias("ceiling"), wrong.alias("wrong"), F.count("*").alias("records"))


def word_frequencies(records: DataFrame) -> DataFrame:
    return records.select(F.explode(tx.pre_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
