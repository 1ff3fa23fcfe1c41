"""Which pages of a catalogue to fetch next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_plan(listed: DataFrame, catalog: DataFrame, key: str, now, ttl_hours: float = 24, max_fetches: int = 300) -> DataFrame:
    """``(key, last_ts, action)``: "fresh", "fetch" (oldest first, at most ``max_fetches``),
    "waiting", or "removed" for what the catalogue has and the list has not.

    The places of the due pages are needed only up to the limit, so they come from a
    top-``max_fetches`` and not from a ranking of all.
    """
    now = F.lit(now).cast("timestamp")
    joined = listed.select(key).distinct().withColumn("_listed", F.lit(True)).join(catalog.select(key, "last_ts"), key, "full")
    # a page is due once its copy is as old as the time to live
    due = F.col("last_ts").isNull() | (F.col("last_ts") <= now - F.make_dt_interval(hours=F.lit(int(ttl_hours))))
    state = joined.withColumn("action", F.when(F.col("_listed").isNull(), "removed").when(due, "due").otherwise("fresh")).drop("_listed")
    first = state.where("action = 'due'").orderBy(F.col("last_ts").asc_nulls_first(), key).limit(max_fetches).select(key, F.lit(True).alias("_now"))
    action = F.when(F.col("action") == "due", F.when(F.col("_now"), "fetch").otherwise("waiting")).otherwise(F.col("action"))
    return state.join(first, key, "left").select(key, "last_ts", action.alias("action"))
