"""Extension: histograms of samples that arrive as files, kept as a mergeable table of counts.

Counts of a batch are added to a Parquet dataset under the batch's number, so that a batch that runs again replaces
its own counts; a histogram is the sum over batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.histogram import KEYS, histogram


def ingest(source: DataFrame, to_samples: Callable[[DataFrame], DataFrame], counts: str, checkpoint: str, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Counts everything that is there, batch by batch, and stops. `source` is a streaming table."""

    def add(batch: DataFrame, number: int) -> None:
        histogram(to_samples(batch), keys).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, counts: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return spark.read.parquet(counts).groupBy(*keys, "code").agg(F.sum("n").alias("n"))


def windowed(events: DataFrame, time: str, code: str, minutes: int = 60, late_minutes: int = 120) -> DataFrame:
    """Range statistics per tumbling window of a stream (or table) of coded values, with a watermark for late rows."""
    span, late = f"{minutes} minutes", f"{late_minutes} minutes"
    return events.withWatermark(time, late).groupBy(F.window(time, span)).agg(F.min(code).alias("low"), F.max(code).alias("high"), F.count("*").alias("n")).select("window.start", "low", "high", "n")
