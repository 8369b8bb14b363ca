"""Multinomial naive Bayes in sparse long form; training and scoring are aggregations and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ModelError


@dataclass(frozen=True)
class NaiveBayes:
    """``likelihoods`` (label, token, ll) of pairs seen together; ``classes`` (label, lp, other) with the log prior and the likelihood of unseen pairs; ``vocabulary`` (token)."""

    likelihoods: DataFrame
    classes: DataFrame
    vocabulary: DataFrame


def train(counts: DataFrame, labels: DataFrame, alpha: float = 1.0) -> NaiveBayes:
    """From (record_id, token, n) and (record_id, label)."""
    if alpha <= 0:
        raise ModelError(f"smoothing of {alpha} is not above 0", "use 1")
    seen = counts.join(labels, "record_id").groupBy("label", "token").agg(F.sum("n").alias("n"))
    vocabulary = counts.select("token").distinct()
    size = vocabulary.agg(F.count("*").alias("v")).withColumn("k", F.lit(1))
    per_class = labels.groupBy("label").agg(F.count("*").alias("docs"))
    tokens = seen.groupBy("label").agg(F.sum("n").alias("tokens"))
    # One row for each class from here on.
    classes = (
        per_class.join(tokens, "label", "left")
        .withColumn("k", F.lit(1)).join(size, "k")
        .withColumn("all_docs", F.sum("docs").over(Window.partitionBy()))
        .select(
            "label", "docs",
            F.ln(F.col("docs") / F.col("all_docs")).alias("lp"),
            (F.coalesce("tokens", F.lit(0)) + alpha * F.col("v")).alias("mass"),
        )
        .withColumn("other", F.ln(F.lit(alpha) / F.col("mass")))
    )
    ll = seen.join(F.broadcast(classes.select("label", "mass")), "label").select("label", "token", F.ln((F.col("n") + alpha) / F.col("mass")).alias("ll"))
    return NaiveBayes(ll, classes, vocabulary)


def scores(model: NaiveBayes, counts: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, label, score). A pair never seen together adds the class's own value, so only seen pairs are joined."""
    known = counts.join(model.vocabulary, "token", "left_semi")
    total = known.groupBy("record_id").agg(F.sum("n").alias("total"))
    lift = (
        known.join(model.likelihoods, "token")
        .join(F.broadcast(model.classes.select("label", "other")), "label")
        .groupBy("record_id", "label")
        .agg(F.sum(F.col("n") * (F.col("ll") - F.col("other"))).alias("lift"))
    )
    # Every record has a score for every class: the classes as one array, not a join.
    all_classes = model.classes.agg(F.array_sort(F.collect_list(F.struct("label", "lp", "other"))).alias("cs")).withColumn("k", F.lit(1))
    base = records.select("record_id").join(total, "record_id", "left").withColumn("k", F.lit(1)).join(F.broadcast(all_classes), "k")
    listed = base.select("record_id", "total", F.explode("cs").alias("c")).select("record_id", "total", "c.label", "c.lp", "c.other")
    return listed.join(lift, ["record_id", "label"], "left").select(
        "record_id", "label", (F.col("lp") + F.coalesce("total", F.lit(0)) * F.col("other") + F.coalesce("lift", F.lit(0.0))).alias("score")
    )


def predictions(scored: DataFrame) -> DataFrame:
    """(record_id, predicted, confidence): the best class, of equal ones the first; its softmax share."""
    best = scored.groupBy("record_id").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "label")).alias("all"))
    predicted = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("top")), lambda x: x["label"]))
    mass = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("top")))
    return best.select("record_id", predicted.alias("predicted"), (1 / mass).alias("confidence"))


def probabilities(scored: DataFrame) -> DataFrame:
    """(record_id, label, probability): the softmax share of every class, of which a record has a handful."""
    own = Window.partitionBy("record_id")
    mass = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    return mass.select("record_id", "label", (F.col("e") / F.sum("e").over(own)).alias("probability"))


def parameters(model: NaiveBayes) -> int:
    """Numbers that the dense model has."""
    k = model.classes.count()
    return k * model.vocabulary.count() + k
