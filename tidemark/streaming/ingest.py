"""Records that arrive as a stream: validated batch by batch, late and repeated ones handled by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import text as tx
from tidemark.sources.corpus import first_problem


def timed(stream: DataFrame, time_col: str) -> DataFrame:
    """Event times with a zone (that of the session), as watermarks need them."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def deduplicated(stream: DataFrame, *, time_col: str = "ingested_at", lateness: str = "120 days") -> DataFrame:
    """The first row of each (record_id, text) within the lateness; the state is bounded by the watermark."""
    return timed(stream, time_col).withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["record_id", "text"])


def daily_labels(stream: DataFrame, *, time_col: str = "ingested_at", lateness: str = "120 days") -> DataFrame:
    """Records by day and label."""
    return timed(stream, time_col).withWatermark(time_col, lateness).groupBy(F.window(time_col, "1 day").alias("day"), "label").agg(F.count("*").alias("records"))


def into_corpus(stream: DataFrame, folder: str, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Valid records to ``folder``/records and invalid ones with their first problem to ``folder``/refused.

    Each batch has a folder of its own by its number, so a batch that is tried
    again replaces what its first try left.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("reason", first_problem()).withColumn("norm", tx.normalise(F.col("text"))).persist()
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{folder}/records/batch={number}")
        batch.where("reason is not null").select("record_id", "reason").write.mode("overwrite").parquet(f"{folder}/refused/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
