"""Scores of predictions, paired comparison, confusion, and comparison with a stored baseline.

Predictions are (record_id, model, target, predicted, confidence).
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import BaselineError, EvaluationError

TOLERANCE, ALPHA = 0.005, 0.05


def per_class(rows: DataFrame, space: DataFrame) -> DataFrame:
    """(model, label, support, precision, recall, f1) over the whole label space; undefined values are 0."""
    ones = rows.select(
        "model",
        F.explode(
            F.array(
                F.struct(F.col("target").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("target") == F.col("predicted")).cast("int").alias("h")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")),
            )
        ).alias("x"),
    )
    counted = ones.groupBy("model", "x.label").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    labels = space.agg(F.array_sort(F.collect_set("label")).alias("ls")).withColumn("k", F.lit(1))
    grid = rows.select("model").distinct().withColumn("k", F.lit(1)).join(labels, "k").select("model", F.explode("ls").alias("label"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = grid.join(counted, ["model", "label"], "left").select("model", "label", n("t").alias("support"), n("p").alias("p"), n("h").alias("h"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = full.withColumn("precision", share("h", "p")).withColumn("recall", share("h", "support"))
    f1 = F.when(F.col("support") + F.col("p") > 0, 2 * F.col("h") / (F.col("support") + F.col("p"))).otherwise(0.0)
    return scored.select("model", "label", "support", "precision", "recall", f1.alias("f1"))


def overall(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(model, records, accuracy, macro_f1, mean_confidence, top_decile_accuracy, worst_label)."""
    if rows.isEmpty():
        raise EvaluationError("there are no predictions to score", "give predictions")
    hit = (F.col("target") == F.col("predicted")).cast("int")
    facts = rows.groupBy("model").agg(F.count("*").alias("records"), F.avg(hit).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    macro = classes.groupBy("model").agg(F.avg("f1").alias("macro_f1"), F.min_by("label", F.struct("f1", "label")).alias("worst_label"))
    return facts.join(macro, "model").join(top_decile(rows), "model", "left")


def top_decile(rows: DataFrame) -> DataFrame:
    """(model, top_decile_accuracy): of the max(1, n // 10) most confident; equal confidences in order of record_id.

    The confidence at the cut is found from counts by confidence; only the rows
    at that confidence are put in order.
    """
    sure = rows.where("confidence is not null").withColumn("hit", (F.col("target") == F.col("predicted")).cast("int"))
    counts = sure.groupBy("model", "confidence").agg(F.count("*").alias("c"), F.sum("hit").alias("h"))
    order = Window.partitionBy("model").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("take", F.greatest(F.lit(1), F.floor(F.sum("c").over(Window.partitionBy("model")) / 10)))
    whole = ranked.where("upto <= take").groupBy("model").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    at = ranked.where("upto > take and upto - c < take").select("model", "confidence", (F.col("take") - F.col("upto") + F.col("c")).alias("more"))
    tied = sure.join(at, ["model", "confidence"]).withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("record_id"))).where("r <= more")
    part = tied.groupBy("model").agg(F.count("*").alias("c"), F.sum("hit").alias("h"))
    return whole.unionByName(part).groupBy("model").agg((F.sum("h") / F.sum("c")).alias("top_decile_accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", "target", "predicted").agg(F.count("*").alias("n"))


def most_confused(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent mistakes of each model: (model, target, predicted, n, place)."""
    order = Window.partitionBy("model").orderBy(F.desc("n"), "target", "predicted")
    return confusion(rows).where("target != predicted").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def discordant(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row (both, only_left, only_right, neither) over the records that both models predicted."""
    hit = lambda m: F.max(F.when(F.col("model") == m, (F.col("target") == F.col("predicted")).cast("int")))
    paired = rows.where(F.col("model").isin(left, right)).groupBy("record_id").agg(hit(left).alias("l"), hit(right).alias("r")).where("l is not null and r is not null")
    return paired.agg(
        F.count_if(F.expr("l = 1 and r = 1")).alias("both"),
        F.count_if(F.expr("l = 1 and r = 0")).alias("only_left"),
        F.count_if(F.expr("l = 0 and r = 1")).alias("only_right"),
        F.count_if(F.expr("l = 0 and r = 0")).alias("neither"),
    )


def mcnemar(only_left: int, only_right: int) -> float:
    """Exact two-sided probability of discordant counts as uneven as these; 1 for none."""
    n, k = only_left + only_right, min(only_left, only_right)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def comparison(only_left: int, only_right: int, alpha: float = ALPHA) -> str:
    p = mcnemar(only_left, only_right)
    word = "different" if p < alpha else "indistinguishable"
    return f"{word} (p = {p:.3f} over {only_left + only_right} discordant records)"


def verdict(baseline: DataFrame, current: DataFrame, *, tolerance: float = TOLERANCE, baseline_digest: str = "", digest: str = "") -> DataFrame:
    """(model, metric, before, now, delta, change) of (model, metric, value) tables; models on one side only are added or removed."""
    if baseline_digest and digest and baseline_digest != digest:
        raise BaselineError("the baseline was measured on another split", "measure a baseline on this split")
    b = baseline.select("model", "metric", F.col("value").alias("before"))
    n = current.select("model", "metric", F.col("value").alias("now"))
    delta = F.col("now") - F.col("before")
    change = (
        F.when(F.col("now").isNull(), "removed")
        .when(F.col("before").isNull(), "added")
        .when(delta < -tolerance, "regression")
        .when(delta > tolerance, "improvement")
        .otherwise("unchanged")
    )
    return b.join(n, ["model", "metric"], "full_outer").select("model", "metric", "before", "now", delta.alias("delta"), change.alias("change"))


def passed(verdicts: DataFrame) -> DataFrame:
    """One row: whether nothing regressed and nothing was removed."""
    return verdicts.agg((F.count_if(F.col("change").isin("regression", "removed")) == 0).alias("passed"), F.count_if(F.col("change") == "regression").alias("regressions"))
