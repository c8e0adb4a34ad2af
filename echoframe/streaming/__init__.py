"""Exact duplicates in a stream of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoframe.functions.normalize import normalize_code


def first_seen(stream: DataFrame, ts: str, watermark: str = "1 hour") -> DataFrame:
    """The units of a stream whose normalised body has not come before within the watermark; state is bounded by it."""
    return stream.withColumn("norm_key", F.sha2(normalize_code(F.col("body")), 256)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["norm_key"])


def repeats(stream: DataFrame, ts: str, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Counts of each normalised body by event-time window; late units count until the watermark passes."""
    keyed = stream.withColumn("norm_key", F.sha2(normalize_code(F.col("body")), 256)).withWatermark(ts, watermark)
    return keyed.groupBy(F.window(ts, window).alias("during"), "norm_key").agg(F.count("*").alias("n_units"), F.min("idx").alias("first_idx"))
