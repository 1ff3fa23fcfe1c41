"""Captures kept over time: an append-only history by day, and the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_history(captures: DataFrame, path: str) -> None:
    """Adds captures; those without a capture time have no place in time and are left out."""
    captures.where("captured_at is not null").withColumn("capture_date", F.to_date("captured_at")).write.mode("append").partitionBy("capture_date").parquet(path)


def read_history(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Captures between two times, both inclusive; whole days outside are not read."""
    out = spark.read.parquet(path)
    for value, keep in ((since, lambda a, b: a >= b), (until, lambda a, b: a <= b)):
        if value is not None:
            at = F.lit(value).cast("timestamp")
            out = out.where(keep(F.col("capture_date"), F.to_date(at)) & keep(F.col("captured_at"), at))
    return out.drop("capture_date")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key, of equal ones the smallest ``tie``; aggregated before it is shuffled.

    ``at`` is a time or a number, and a row without one comes last; ``tie`` can be anything that has an order.
    """
    # what comes first by (latest, tie) as a minimum, since not every kind of tie can be negated
    age = -F.unix_micros(F.col(at).cast("timestamp")) if dict(rows.dtypes)[at] in ("timestamp", "timestamp_ntz", "date") else -F.col(at).cast("double")
    newest = rows.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(F.col(at).isNull(), age.alias("age"), F.col(tie).alias("tie"))).alias("_row"))
    return newest.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def record_and_read(spark: SparkSession, captures: DataFrame, path: str, since=None, until=None) -> DataFrame:
    """Appends fresh captures, then gives the history in range. If the captures fail, so does this."""
    append_history(captures, path)
    return read_history(spark, path, since, until)
