"""Streams of run events: counters kept up to date, windows with late rows, running call rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run_id string, id string, family string, channel string, label string, verdict string, cached boolean, error string, prompt_tokens int, completion_tokens int, retries_429 int, latency_s double, logged_at timestamp, arrived_at timestamp"


def event_stream(spark: SparkSession, folder: str, kind: str = "json", files: int = 50) -> DataFrame:
    """Events as their files arrive, a bounded number a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).format(kind).load(folder)


def once(events: DataFrame, late: str = "14 days") -> DataFrame:
    """Events sent again are dropped while the watermark still knows them."""
    return events.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "id", "logged_at"])


def window_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Rows and errors of each run by windows of the logged time; late rows count until the watermark passes.

    late: how late rows may be, for a stream that has no watermark yet (``once`` sets one).
    """
    counted = (events.withWatermark("logged_at", late) if late else events).groupBy(F.window("logged_at", size).alias("w"), "run_id")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "error").alias("errors")).select("run_id", F.col("w.start").alias("start"), "n", "errors")


def keep_counters(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Start a query whose sink gets each batch's counters with the batch number, by which a repeated batch can be told."""

    def each(batch: DataFrame, number: int) -> None:
        sink(batch.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "error").alias("errors"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens")), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
