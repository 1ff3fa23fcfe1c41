"""Captures as a stream: deduplicated within a watermark, counted by period, kept as history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.schema import OBSERVATION

#: Weeks begin on Monday, and the epoch was a Thursday.
MONDAY = "4 days"


def capture_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """JSON lines of observations that appear in a folder."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_at_once).json(folder)


def unique_captures(captures: DataFrame, lateness: str = "14 days") -> DataFrame:
    """One row a source, listing and capture time; state lives as long as the watermark lets rows be late."""
    return captures.withWatermark("captured_at", lateness).dropDuplicatesWithinWatermark(["source_id", "listing_id", "captured_at"])


def weekly_supply(unique: DataFrame) -> DataFrame:
    """Listings and mean price by source, currency and week; a week comes out once it is closed.

    Sellers are counted in bounded state, hence approximately; exact counts are the batch analysis's.
    """
    week = F.window("captured_at", "7 days", startTime=MONDAY)
    counted = unique.groupBy(week.alias("week"), "source_id", "currency").agg(F.count("*").alias("listing_count"), F.approx_count_distinct("seller").alias("sellers_approx"), F.avg("price").alias("price_mean"))
    return counted.select(F.col("week.start").alias("period_start"), F.col("week.end").alias("period_end"), "source_id", "currency", "listing_count", "sellers_approx", "price_mean")


def keep_history(unique: DataFrame, path: str, checkpoint: str):
    """Appends to a history by day, exactly once; returns the started query."""
    dated = unique.withColumn("capture_date", F.to_date("captured_at"))
    return dated.writeStream.format("parquet").partitionBy("capture_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh_periods(captures: DataFrame, checkpoint: str, recompute):
    """Calls ``recompute(periods, batch)`` with the weeks each batch touches, for what cannot be
    kept incrementally, as exact medians; returns the started query."""
    def batch(rows: DataFrame, number: int) -> None:
        recompute(rows.select(F.date_trunc("week", "captured_at").alias("period")).distinct(), number)

    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
