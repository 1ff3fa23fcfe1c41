"""Periods, series of periods, and how a series moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month")


def period_start(ts: Column, granularity: str) -> Column:
    """The begin of the day, week (from Monday) or month, in the session's time zone."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return F.date_trunc(granularity, ts)


def period_end(start: Column, granularity: str) -> Column:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return F.timestamp_add(granularity.upper(), F.lit(1), start)


def change_pct(new: Column, old: Column) -> Column:
    return F.when(old != 0, (new - old) / old * 100)


def classify(series: Column, threshold: float, min_periods: int = 3) -> Column:
    """How an array of values by period moves, as a struct; nulls are periods without a value.

    ``classification`` is INSUFICIENTE, APARICION, DESAPARICION, ESTABLE, CAMBIO_PUNTUAL,
    TENDENCIA, MOVIMIENTO_RECIENTE or SIN_PATRON_CLARO. Figures are unrounded.
    """
    v = F.filter(series.cast("array<double>"), lambda x: x.isNotNull())
    n = F.size(v)
    first, last, before = F.get(v, F.lit(0)), F.get(v, n - 1), F.get(v, n - 2)
    total, recent = change_pct(last, first), change_pct(last, before)

    def direction(c):
        return F.when(F.abs(c) < threshold, "ESTABLE").when(c > 0, "ALZA").otherwise("BAJA")

    heads, tails = F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(1)))
    steps = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    along = F.size(F.filter(steps, lambda s: ((s["b"] > s["a"]) & (total > 0)) | ((s["b"] < s["a"]) & (total < 0))))
    consistency = along / (n - 1)
    early = change_pct(before, first) * F.signum(total) >= threshold / 2
    calm = F.forall(steps, lambda s: (s["a"] == 0) | (F.abs((s["b"] - s["a"]) / F.nullif(s["a"], F.lit(0.0)) * 100) < threshold))
    appears, vanishes = (first == 0) & (last > 0), (last == 0) & (before > 0)
    measured = total.isNotNull() & recent.isNotNull()
    trend = (F.abs(total) >= threshold) & (consistency >= 2 / 3) & F.coalesce(early, F.lit(False)) & (n >= min_periods)
    kind = (
        F.when(n < 2, "INSUFICIENTE").when(appears, "APARICION").when(vanishes, "DESAPARICION").when(~measured, "INSUFICIENTE")
        .when(n == 2, F.when(F.abs(total) < threshold, "ESTABLE").otherwise("CAMBIO_PUNTUAL"))
        .when(trend, "TENDENCIA").when(F.abs(recent) >= threshold, "MOVIMIENTO_RECIENTE").when((F.abs(total) < threshold) & calm, "ESTABLE").otherwise("SIN_PATRON_CLARO")
    )
    way = F.when(kind == "APARICION", "ALZA").when(kind == "DESAPARICION", "BAJA").when(kind == "MOVIMIENTO_RECIENTE", direction(recent)).when(kind == "ESTABLE", "ESTABLE").when(kind != "INSUFICIENTE", direction(total))
    figures = (n >= 2) & ~appears
    return F.struct(
        kind.alias("classification"), way.alias("direction"), F.when(figures, total).alias("change_pct_total"),
        F.when(figures, F.when(vanishes, -100.0).otherwise(recent)).alias("change_pct_last"), n.alias("periods_with_data"),
        F.when(figures & ~vanishes & measured & (n > 2), consistency).alias("consistency"), F.lit(float(threshold)).alias("threshold_pct"),
    )


def series(periods: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``(*keys, series)``: the values by period in order, nulls included. One entry a period."""
    return periods.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v")))).alias("_s")).select(*keys, F.col("_s.v").alias("series"))


def dense(periods: DataFrame, keys: list[str], by: list[str], order: str) -> DataFrame:
    """A row for every group that ``keys`` and ``by`` name in every period of its ``keys``, null where it had none."""
    every = periods.select(*keys, order).distinct().join(periods.select(*keys, *by).distinct(), keys) if keys else _every(periods, by, order)
    return every.join(periods, [*keys, *by, order], "left")


def _every(periods: DataFrame, by: list[str], order: str) -> DataFrame:
    one = periods.withColumn("_one", F.lit(1))
    return one.select("_one", order).distinct().join(one.select("_one", *by).distinct(), "_one").drop("_one")


def common_sources(captured: DataFrame, keys: list[str], order: str, source: str = "source_id") -> DataFrame:
    """``(*keys, source)`` of the sources that were captured in every period of ``keys``."""
    seen = captured.select(*keys, order, source).distinct()
    total = seen.select(*keys, order).distinct().groupBy(*keys).agg(F.count("*").alias("_all"))
    each = seen.groupBy(*keys, source).agg(F.count("*").alias("_n"))
    joined = each.join(total, keys) if keys else each.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    return joined.where("_n = _all").select(*keys, source)


def unusual(series_: Column, min_history: int = 5, limit: float = 3.5) -> Column:
    """The last value against the ones before: a struct (last, median, z, n), null unless it stands out."""
    v = F.filter(series_.cast("array<double>"), lambda x: x.isNotNull())
    n = F.size(v)
    past = F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(1)))

    def median(a):
        s, k = F.array_sort(a), F.size(a)
        return (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2

    mid = median(past)
    mad = median(F.transform(past, lambda x: F.abs(x - mid)))
    z = 0.6745 * (F.get(v, n - 1) - mid) / F.nullif(mad, F.lit(0.0))
    return F.when((n >= min_history + 1) & (F.abs(z) > limit), F.struct(F.get(v, n - 1).alias("last"), mid.alias("median"), z.alias("robust_z"), (n - 1).alias("historical_periods")))
