"""Label space, fixed-length encodings and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ModelError


def label_space(train: DataFrame) -> DataFrame:
    """(label, idx): the distinct labels of the training side, in order. A fixed handful of rows."""
    labels = train.select("label").where("label is not null").distinct()
    return labels.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def with_targets(records: DataFrame, space: DataFrame) -> DataFrame:
    """Records with the index of their label; a label outside the space is an error."""
    unseen = records.join(F.broadcast(space), "label", "left_anti").select("label").distinct().limit(5).collect()
    if unseen:
        raise ModelError(f"labels {sorted(str(r['label']) for r in unseen)} are not in the training side", "train on data with every label")
    return records.join(F.broadcast(space), "label")


def truncated(encoded: DataFrame, max_tokens: int = 64) -> DataFrame:
    """(record_id, ids, length, cut): the first tokens, their number, and whether some were cut off."""
    return encoded.select("record_id", F.slice("ids", 1, max_tokens).alias("ids"), F.least(F.size("ids"), F.lit(max_tokens)).alias("length"), (F.size("ids") > max_tokens).alias("cut"))


def encoding_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("records"), F.count_if("cut").alias("truncated"), F.count_if(F.col("length") == 0).alias("empty"), F.floor(F.percentile("length", 0.5)).alias("median_length")
    )


def token_counts(rows: DataFrame, tokens: str = "ids") -> DataFrame:
    """Sparse counts (record_id, token, n)."""
    return rows.select("record_id", F.explode(tokens).alias("token")).groupBy("record_id", "token").agg(F.count("*").alias("n"))
