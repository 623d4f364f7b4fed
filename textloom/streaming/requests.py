"""Streams of search requests. An extension: the behaviours exist in interactive clients, here they are stateful stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(requests: DataFrame, gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """user, query, asked_at: the last request of each burst of a user, where a burst ends with a pause of ``gap``.

    requests: user, query, ts. Rows that are later than ``late`` are dropped, as the watermark says."""
    burst = requests.withWatermark("ts", late).groupBy("user", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("query", "ts").alias("query"), F.max("ts").alias("asked_at")).select("user", "query", "asked_at")


def first_asked(requests: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Requests whose key has not been seen within the time that answers are kept; state older than that is forgotten.

    requests: cache_key, ts and more."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["cache_key"])


def upsert_answers(answers: DataFrame, path: str, checkpoint: str):
    """Writes a stream of answers (cache_key, answer, stored_at) to a table by day; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return answers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
