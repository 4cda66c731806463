"""Streams of patches and points: the same operators on arriving files.

The engine's checks are row-wise or keyed by slide, so they run unchanged on a
stream. What a stream adds is repeats that arrive later: they are dropped within
a watermark, so the state stays bounded, and counts close with event time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PATCH_KEY = ("slide_id", "x", "y", "w", "h", "label")


def arriving(spark: SparkSession, folder: str, schema, *, files_a_batch: int = 100, names: str = "*") -> DataFrame:
    """Parquet files as they are added to ``folder``; ``names`` is a pattern of theirs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", names).parquet(folder)


def first_arrivals(stream: DataFrame, *, key: Sequence[str] = PATCH_KEY, time: str = "saved_at", delay: str = "1 hour") -> DataFrame:
    """Each patch once; a repeat within the delay is dropped. Rows without a
    time are never late and pass."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(stream: DataFrame, *, time: str = "saved_at", window: str = "10 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, end, slide_id, label, n) a time window; late rows are dropped once
    the watermark has passed their window."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    g = stream.withWatermark(time, delay).groupBy(w.alias("w"), "slide_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "slide_id", "label", "n")


def sessions(stream: DataFrame, *, time: str = "saved_at", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of work on a slide: (start, end, slide_id, n), parted by gaps."""
    g = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "slide_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "slide_id", "n")


def store(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, exactly once, until the files that are there are done."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
