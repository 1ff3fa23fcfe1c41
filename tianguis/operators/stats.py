"""Robust price statistics by group. All values are exact and unrounded; see plans for rounding.

Groups are aggregated in two stages and their figures joined back, so that a dominant
currency is spread over tasks; nothing is computed in a window over a whole group. Medians and
quartiles are exact and split as well: see ``quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tianguis.operators.components import durable

# The outlier rule's constants.
Z_SCALE, Z_LIMIT, MAD_FLOOR, FENCE, RATIO = 0.6745, 3.5, 0.05, 3.0, 3.0


#: Lots an octave of values has.
LOTS = 256
#: Groups whose figures are broadcast, at most.
FEW = 100_000


def _lot(v: Column) -> Column:
    """The lot of a value, in the order of the values, on a scale of its logarithm."""
    size = F.floor(F.log2(F.abs(v)) * LOTS).cast("long") + 2000 * LOTS
    return F.when(F.isnan(v), 1 << 40).when(v == 0, 0).when(v == float("inf"), 1 << 39).when(v == float("-inf"), -(1 << 39)).otherwise(F.signum(v).cast("long") * size)


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has a row for each of its keys at most; a null key equals a null."""
    named = right.select(*[F.col(k).alias("_r_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named["_r_" + k])
    return left.join(named, on, how).drop(*["_r_" + k for k in keys])


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(*keys, _v, _c)``: how often each group has each value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))


def quantiles(counts: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """``(*keys, *points)`` of ``counted`` values, exact, between neighbours by linear interpolation.

    Values are dealt into lots by size. The lots' counts, a few thousand a group, tell which
    lots have the ranks that the quantiles need; only these are put in order, each by itself.
    """
    lots = counts.groupBy(*keys, _lot(F.col("_v")).alias("_lot")).agg(F.sum("_c").alias("_k"))
    group = Window.partitionBy(*keys)
    placed = lots.withColumns({"_end": F.sum("_k").over(group.orderBy("_lot").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_k").over(group)})
    ranks = {name: (F.col("_n") - 1) * F.lit(q) for name, q in points.items()}

    def holds(rank: Column, end: Column, size: Column) -> Column:
        return (rank < end) & (rank >= end - size)

    any_rank = F.lit(False)
    for r in ranks.values():
        any_rank = any_rank | holds(F.floor(r), F.col("_end"), F.col("_k")) | holds(F.ceil(r), F.col("_end"), F.col("_k"))
    hit = placed.where(any_rank).select(*keys, "_lot", "_n", (F.col("_end") - F.col("_k")).alias("_before"))
    inside = _beside(counts.withColumn("_lot", _lot(F.col("_v"))), hit, [*keys, "_lot"])
    run = Window.partitionBy(*keys, "_lot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ended = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(run))
    ends = []
    for name, r in ranks.items():
        for side, rank in (("lo", F.floor(r)), ("hi", F.ceil(r))):
            ends.append(F.max(F.when(holds(rank, F.col("_end"), F.col("_c")), F.col("_v"))).alias(f"_{side}_{name}"))
    found = ended.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    share = {name: r - F.floor(r) for name, r in ranks.items()}
    return found.select(*keys, *[((1 - share[name]) * F.col(f"_lo_{name}") + share[name] * F.col(f"_hi_{name}")).alias(name) for name in points])


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(counted(rows, keys, value), keys, {name: 0.5})


def price_summary(rows: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """What describes a group of prices; figures that need more rows than there are are null."""
    v, n = F.col(value), F.col("n")
    used = rows.where(v.isNotNull())
    plain = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("price_min"), F.max(v).alias("price_max"), F.avg(v).alias("price_mean"), F.stddev_samp(v).alias("_sd"),
    )
    out = _beside(plain, quantiles(counted(used, keys, value), keys, {"price_median": 0.5, "_q1": 0.25, "_q3": 0.75}), keys)
    span = F.col("price_max") - F.col("price_min")
    return out.select(
        *keys, "n", "price_min", "price_max", "price_mean", "price_median", span.alias("price_range"),
        F.when((n >= 2) & (F.col("price_median") > 0), span / F.col("price_median") * 100).alias("price_spread_pct"),
        F.when(n >= 4, F.col("_q1")).alias("p25"), F.when(n >= 4, F.col("_q3")).alias("p75"), F.when(n >= 4, F.col("_q3") - F.col("_q1")).alias("iqr"),
        F.when((n >= 3) & (F.col("price_mean") > 0), F.col("_sd") / F.col("price_mean")).alias("coefficient_of_variation"),
    )


def outliers(rows: DataFrame, keys: list[str], value: str = "price", name: str = "outlier", first: bool = False) -> DataFrame:
    """Adds ``{name}_method`` and ``{name}``, a struct (direction, method, score) or null.

    Groups under 3 are not judged. From 5 on: the modified z-score, its MAD at least 5 % of
    the median, or fences of 3 quartile ranges where the MAD is 0. Between: the ratio to the
    median. Rows with a null value are not judged and keep a null. With ``first`` the groups'
    figures are worked out at once and, up to FEW groups, go to the rows, which stay where they are.
    """
    v = F.col(value)
    # all figures come from how often a group has a value, rows are only joined to them at the end
    counts = counted(rows, keys, value)
    centre = _beside(counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), quantiles(counts, keys, {"_med": 0.5, "_q1": 0.25, "_q3": 0.75}), keys)
    away = _beside(counts, centre.select(*keys, "_med"), keys).groupBy(*keys, F.abs(F.col("_v") - F.col("_med")).alias("_v")).agg(F.sum("_c").alias("_c"))
    figures = _beside(centre, quantiles(away, keys, {"_mad": 0.5}), keys).select(*[F.col(k).alias("_k_" + k) for k in keys], "_n", "_med", "_q1", "_q3", "_mad")
    if first:
        figures = durable(figures)
        figures = F.broadcast(figures) if figures.count() <= FEW else figures
    out = rows.join(figures, _on(keys), "left")
    n, med, mad, q1, q3 = (F.col(c) for c in ("_n", "_med", "_mad", "_q1", "_q3"))
    iqr = q3 - q1
    z = Z_SCALE * (v - med) / F.greatest(mad, MAD_FLOOR * F.abs(med))
    method = (
        F.when(n < 3, "no_evaluado_muestra_insuficiente").when((n >= 5) & (mad > 0), "mad_zscore").when(n >= 5, "iqr")
        .when(med <= 0, "no_evaluado_mediana_no_positiva").otherwise("ratio_mediana")
    )
    far_fence = (v < q1 - FENCE * iqr) | (v > q3 + FENCE * iqr) | ((iqr == 0) & (med > 0) & ((v > RATIO * med) | (v < med / RATIO)))
    ratio = F.when(med != 0, v / med).otherwise(0.0)

    def flag(up, score):
        return F.struct(F.when(up, "ALTO").otherwise("BAJO").alias("direction"), method.alias("method"), score.alias("score"))

    judged = v.isNotNull()
    flagged = (
        F.when(judged & (method == "mad_zscore") & (F.abs(z) > Z_LIMIT), flag(z > 0, z))
        .when(judged & (method == "iqr") & far_fence, flag(v > med, ratio))
        .when(judged & (method == "ratio_mediana") & ((ratio > RATIO) | (ratio < 1 / RATIO)), flag(ratio > 1, ratio))
    )
    return out.withColumn(name, flagged).withColumn(name + "_method", F.when(judged, method)).drop(*["_k_" + k for k in keys], "_n", "_med", "_q1", "_q3", "_mad")


def _on(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col("_k_" + k))
    return out


def breakdown(rows: DataFrame, keys: list[str], dimensions: list[str], value: str = "price") -> DataFrame:
    """``(*keys, dimension, bucket, n, price_median, price_min, price_max)`` for several dimensions in one scan.

    A null bucket is "desconocida".
    """
    v = F.col(value)
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("desconocida")).alias("bucket")) for d in dimensions])
    # counted by value before it is asked by dimension
    counts = rows.groupBy(*keys, *dimensions, v.cast("double").alias("_v")).agg(F.count("*").alias("_c")).select(*keys, "_v", "_c", F.explode(named).alias("_d"))
    by = [*keys, "dimension", "bucket"]
    counts = counts.select(*keys, "_d.dimension", "_d.bucket", "_v", "_c").groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    plain = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("price_min"), F.max("_v").alias("price_max"))
    out = _beside(plain, quantiles(counts.where(F.col("_v").isNotNull()), by, {"price_median": 0.5}), by, "left")
    return out.select(*by, "n", "price_median", "price_min", "price_max")


def max_gap(buckets: DataFrame, keys: list[str], min_n: int = 3, exclude: tuple = ("desconocida",)) -> DataFrame:
    """``(*keys, low, high, gap_pct)`` between the buckets' medians; ties go to the first bucket.

    Buckets under ``min_n`` rows do not count; groups with fewer than two buckets, or a lowest
    median that is not positive, have no row.
    """
    fit = buckets.where((F.col("n") >= min_n) & ~F.col("bucket").isin(*exclude) if exclude else F.col("n") >= min_n)
    ends = fit.groupBy(*keys).agg(
        F.count("*").alias("_k"), F.min(F.struct("price_median", "bucket")).alias("_lo"),
        F.min(F.struct((-F.col("price_median")).alias("m"), F.col("bucket").alias("b"))).alias("_hi"),
    )
    low, high = F.col("_lo.price_median"), -F.col("_hi.m")
    return ends.where((F.col("_k") >= 2) & (low > 0)).select(*keys, F.col("_lo.bucket").alias("low"), F.col("_hi.b").alias("high"), ((high - low) / low * 100).alias("gap_pct"))


def primary_currency(rows: DataFrame, keys: list[str], currency: str = "currency_norm") -> DataFrame:
    """``(*keys, primary_currency, rows)``: the most frequent currency, of equal ones the first by name."""
    counted = rows.groupBy(*keys, currency).agg(F.count("*").alias("_n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(currency).alias("c"))).alias("_b"))
    return best.select(*keys, F.col("_b.c").alias("primary_currency"), (-F.col("_b.n")).alias("rows"))


def concentration(rows: DataFrame, keys: list[str], seller: str = "seller_norm") -> DataFrame:
    """``(*keys, hhi, top_seller_share_pct, level, listings_without_seller)``: shares of listings, not of sales.

    Under two rows with a known seller the figures are null.
    """
    counted = rows.groupBy(*keys, seller).agg(F.count("*").alias("_c"))
    known = F.when(F.col(seller).isNotNull(), F.col("_c"))
    total, squares, top = F.sum(known), F.sum(known.cast("double") * known), F.max(known)
    hhi = F.col("_squares") / (F.col("_total") * F.col("_total")) * 10000
    out = counted.groupBy(*keys).agg(F.coalesce(total, F.lit(0)).cast("double").alias("_total"), squares.alias("_squares"), top.alias("_top"), F.coalesce(F.sum(F.when(F.col(seller).isNull(), F.col("_c"))), F.lit(0)).alias("listings_without_seller"))
    enough = F.col("_total") >= 2
    return out.select(
        *keys, F.when(enough, hhi).alias("hhi"), F.when(enough, F.col("_top") / F.col("_total") * 100).alias("top_seller_share_pct"),
        F.when(enough, F.when(hhi >= 2500, "ALTA").when(hhi >= 1500, "MODERADA").otherwise("BAJA")).alias("level"), "listings_without_seller",
    )


def supply(rows: DataFrame, keys: list[str], low: int = 3, medium: int = 10) -> DataFrame:
    """Listing, availability, seller and source counts; an unknown availability counts as available."""
    available = F.count_if(~F.col("availability_norm").eqNullSafe("AGOTADO"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("listing_count"), F.count_if(F.col("presentation_status").isin("MISMA", "NO_ESPECIFICADA")).alias("listing_count_same_presentation"),
        available.alias("available_listing_count"), F.count_if(F.col("availability_norm").eqNullSafe("AGOTADO")).alias("sold_out_listing_count"),
        F.countDistinct("seller_norm").alias("seller_count"), F.count_if(F.col("seller_norm").isNull()).alias("listings_without_seller"),
        F.countDistinct("source_id").alias("source_count"),
    )
    return out.withColumn("availability_level", supply_level(F.col("available_listing_count"), low, medium))


def supply_level(available: Column, low: int = 3, medium: int = 10) -> Column:
    return F.when(available == 0, "SIN_OFERTA_OBSERVADA").when(available <= low, "BAJA").when(available <= medium, "MEDIA").otherwise("ALTA")
