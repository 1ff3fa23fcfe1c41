"""Exchange rates: only dated and authorised ones convert, never across a third currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_rates(rates: DataFrame) -> DataFrame:
    """Upper-case codes; a rate that isn't positive or has no date is an error, at run time."""
    good = F.coalesce((F.col("rate") > 0) & F.col("as_of").isNotNull(), F.lit(False))
    checked = F.when(good, F.col("rate")).otherwise(F.raise_error(F.lit("a rate must be positive and dated")).cast("double"))
    return rates.select(F.upper("from_currency").alias("from_currency"), F.upper("to_currency").alias("to_currency"), checked.alias("rate"), "as_of", F.coalesce("source", F.lit("no_especificada")).alias("source"))


def picked_rates(rates: DataFrame, to: str) -> DataFrame:
    """``(currency, factor, rate_as_of, rate_source)``: the newest direct rate, else the inverse of the newest opposite one."""
    r, to = valid_rates(rates), to.upper()
    direct = r.where(F.col("to_currency") == to).select(F.col("from_currency").alias("currency"), F.col("rate").alias("factor"), "as_of", "source", F.lit(1).alias("first"))
    inverse = r.where(F.col("from_currency") == to).select(F.col("to_currency").alias("currency"), (1 / F.col("rate")).alias("factor"), "as_of", "source", F.lit(0).alias("first"))
    best = direct.union(inverse).groupBy("currency").agg(F.max_by(F.struct("factor", "as_of", "source"), F.struct("first", "as_of")).alias("b"))
    return best.select("currency", F.col("b.factor").alias("factor"), F.col("b.as_of").alias("rate_as_of"), F.col("b.source").alias("rate_source"))


def lookup(rates: DataFrame, a: str, b: str, on: Column | None = None, limit: int = 5) -> DataFrame:
    """Rates between two currencies in either direction, newest first, not after ``on``."""
    pair = [a.upper(), b.upper()]
    found = valid_rates(rates).where(F.col("from_currency").isin(pair) & F.col("to_currency").isin(pair) & (F.col("from_currency") != F.col("to_currency") if pair[0] != pair[1] else F.col("from_currency") == F.col("to_currency")))
    return (found if on is None else found.where(F.col("as_of") <= on)).orderBy(F.desc("as_of")).limit(limit)


def as_of(rows: DataFrame, rates: DataFrame, at: str, currency: str, to: str, keys: list[str]) -> DataFrame:
    """Each row with the newest direct rate into ``to`` that is not after ``at``; null where none is.

    Rates are few; their history goes to the rows as one sorted array a currency, so rows are
    neither multiplied nor shuffled by time. ``keys`` are kept for the caller's bookkeeping.
    """
    r = valid_rates(rates).where(F.col("to_currency") == to.upper())
    history = r.groupBy(F.col("from_currency").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("as_of", "rate"))).alias("_h"))
    joined = rows.join(history, F.col(currency) == F.col("_c"), "left")
    past = F.filter("_h", lambda x: x["as_of"] <= F.col(at))
    return joined.withColumn("rate", F.element_at(F.when(F.size(past) > 0, past), -1)["rate"]).drop("_c", "_h")
