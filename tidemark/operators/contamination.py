"""N-gram containment of evaluation records in the training side, calibration, report and gate.

Grams are joined by 128 bits that stand for them. Of the training side only the
grams that the evaluation side has are indexed: where that side is small, its
grams are broadcast and the others never leave their task. A record's score is
an aggregation, so no set of grams is ever held in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ContaminationError
from tidemark.functions import text as tx
from tidemark.operators.lineage import cut
from tidemark.operators.stats import nearest_rank

WIDTH, SHORT_WIDTH, THRESHOLD = 13, 8, 0.5


def gram_rows(records: DataFrame, width: int) -> DataFrame:
    """Distinct (record_id, key) of the n-grams of the records."""
    listed = records.select("record_id", F.explode(tx.windows(tx.words(tx.normalise(F.col("text"))), width)).alias("gram"))
    return listed.select("record_id", tx.gram_key(F.col("gram")).alias("key")).distinct()


def build_index(records: DataFrame, *widths: int, only: DataFrame | None = None) -> DataFrame:
    """Distinct keys of the n-grams of the training side, of all ``widths`` in one pass; with ``only``, of those keys alone."""
    words = records.select(tx.words(tx.normalise(F.col("text"))).alias("w"))
    grams = F.concat(*(tx.windows(F.col("w"), n) for n in widths or (WIDTH,)))
    keys = words.select(F.explode(grams).alias("gram")).select(tx.gram_key(F.col("gram")).alias("key"))
    return (keys if only is None else keys.join(only, "key", "left_semi")).distinct()


def asked_keys(*sides: tuple[DataFrame, int]) -> DataFrame:
    """Distinct keys of the n-grams of evaluation sides (records, width)."""
    return reduce(DataFrame.unionByName, (gram_rows(r, w).select("key") for r, w in sides)).distinct()


def containment(evaluate: DataFrame, index: DataFrame, width: int = WIDTH) -> DataFrame:
    """(record_id, grams, matched, containment); containment is null for a record without a gram."""
    grams = gram_rows(evaluate, width)
    scored = (
        grams.join(index.withColumn("hit", F.lit(1)), "key", "left")
        .groupBy("record_id")
        .agg(F.count("*").alias("grams"), F.count("hit").alias("matched"))
    )
    return (
        evaluate.select("record_id").join(scored, "record_id", "left")
        .select("record_id", F.coalesce("grams", F.lit(0)).alias("grams"), F.coalesce("matched", F.lit(0)).alias("matched"))
        .withColumn("containment", F.when(F.col("grams") > 0, F.col("matched") / F.col("grams")))
    )


def shared_with(null: DataFrame, train: DataFrame) -> DataFrame:
    """Null records that the training side has too, by fingerprint."""
    fp = tx.fingerprint(F.col("label"), F.col("text")).alias("fp")
    return null.withColumn("fp", fp).join(train.select(fp), "fp", "left_semi").drop("fp")


def calibrate(train: DataFrame, null: DataFrame, *, quantile: float = 0.999, width: int = WIDTH, drop_shared: bool = False, index: DataFrame | None = None) -> DataFrame:
    """One row: the threshold that a share ``quantile`` of a disjoint corpus stays below, and what it was measured on."""
    if not 0 < quantile < 1:
        raise ContaminationError(f"a quantile of {quantile} is not between 0 and 1", "give a share such as 0.999")
    shared = cut(shared_with(null, train).select("record_id"))
    dropped = shared.count()
    if dropped and not drop_shared:
        raise ContaminationError(f"{dropped} records of the null corpus are in the training side", "drop them, or give a disjoint corpus")
    rest = null.join(shared, "record_id", "left_anti") if dropped else null
    if dropped and rest.isEmpty():
        raise ContaminationError("every record of the null corpus is in the training side", "give a disjoint corpus")
    if index is None:
        index = build_index(train, width, only=asked_keys((rest, width)))
    scores = containment(rest, index, width)
    level = nearest_rank(scores, "containment", quantile, "threshold").withColumn("k", F.lit(1))
    # One row meets all scores.
    joined = scores.withColumn("k", F.lit(1)).join(F.broadcast(level), "k", "left")
    c = F.col("containment")
    return joined.agg(
        F.max("threshold").alias("threshold"),
        F.count("containment").alias("scored"),
        F.count_if(c.isNull()).alias("not_checkable"),
        F.lit(dropped).cast("long").alias("dropped"),
        (F.count_if(c >= F.col("threshold")) / F.count("containment")).alias("null_rate"),
        (F.count_if(c >= THRESHOLD) / F.count("containment")).alias("null_rate_default"),
    )


def hits(scores: DataFrame, threshold: float) -> DataFrame:
    """Records of at least the threshold; equality is a hit."""
    return scores.where(F.col("containment") >= threshold)


def report(scores: DataFrame, short_scores: DataFrame, threshold: float | DataFrame, calibrated: bool) -> DataFrame:
    """One row: how many records could be checked, how many are hits, at both widths.

    The threshold is a number or the one row of a calibration.
    """
    given = isinstance(threshold, DataFrame)
    level = threshold.select(F.col("threshold").cast("double").alias("t"), F.lit(1).alias("k")) if given else None
    # One row meets all scores.
    at = lambda rows: rows.withColumn("k", F.lit(1)).join(F.broadcast(level), "k") if given else rows.withColumn("t", F.lit(float(threshold)))
    hit = F.count_if(F.col("containment") >= F.col("t"))
    main = at(scores).agg(F.count("*").alias("total"), F.count("containment").alias("evaluated"), hit.alias("hits"), F.max("t").alias("threshold"))
    short = at(short_scores).agg(hit.alias("short_hits"))
    one = main.withColumn("k", F.lit(1)).join(short.withColumn("k", F.lit(1)), "k")
    return one.select(
        "total", "evaluated", "hits", "short_hits",
        F.when(F.col("total") > 0, F.col("evaluated") / F.col("total")).otherwise(0.0).alias("coverage"),
        F.when(F.col("evaluated") > 0, F.col("hits") / F.col("evaluated")).otherwise(0.0).alias("rate"),
        "threshold",
        F.lit(calibrated).alias("calibrated"),
    )


def decision(reports: DataFrame, *, max_contaminated: float = 0.02, min_coverage: float = 0.5, allow_uncalibrated: bool = False) -> DataFrame:
    """The report with a column ``refusal``: null where the gate holds. Equality holds.

    A calibrated threshold of 0 makes every record a hit; it is refused by its own name.
    """
    refusal = (
        F.when(F.col("coverage") < min_coverage, "coverage")
        .when(~F.col("calibrated") & F.lit(not allow_uncalibrated), "uncalibrated")
        .when(F.col("calibrated") & (F.col("threshold") <= 0), "degenerate threshold")
        .when(F.col("rate") > max_contaminated, "contaminated")
    )
    return reports.withColumn("refusal", refusal)


_WHY = {
    "coverage": ("too few records are long enough to be checked", "use a smaller width"),
    "uncalibrated": ("the threshold was not calibrated", "calibrate on a disjoint corpus, or allow it"),
    "degenerate threshold": ("the null corpus has no overlap at all, so its threshold is 0", "calibrate on a corpus of the same domain"),
    "contaminated": ("too many evaluation records are in the training side", "remove them, or split again after removing duplicates"),
}


def enforce(reports: DataFrame, **limits: float | bool) -> None:
    """Raise if the gate refuses the one-row report."""
    row = decision(reports, **limits).first()
    if row["refusal"]:
        raise ContaminationError(*_WHY[row["refusal"]])


def worst(scores: DataFrame, records: DataFrame, threshold: float, n: int = 10) -> DataFrame:
    """The n highest hits with an excerpt of their text."""
    top = hits(scores, threshold).orderBy(F.desc("containment"), "record_id").limit(n)
    return top.join(records.select("record_id", tx.excerpt(F.col("text")).alias("excerpt")), "record_id").orderBy(F.desc("containment"), "record_id")
