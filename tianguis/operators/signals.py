"""Rules over one wide row a target: signals, confidence, indicators, margin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tianguis.config import MarketConfig
from tianguis.functions.numbers import percent_label


def signal_types(cfg: MarketConfig) -> Column:
    """The signals of a row as an array of (type, strength), in a fixed order.

    Reads ``n, price_spread_pct, coefficient_of_variation, seller_count,
    listings_without_seller, price_trend, listing_trend, unusual``.
    """
    spread, cv = F.col("price_spread_pct"), F.col("coefficient_of_variation")
    sellers, price, listing = F.coalesce("seller_count", F.lit(0)), F.col("price_trend"), F.col("listing_trend")
    kind, change, periods = listing["classification"], listing["change_pct_total"], listing["periods_with_data"]
    price_kind, price_way = price["classification"], price["direction"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    moved = yes((kind == "TENDENCIA") & (F.abs(change) >= cfg.supply_change_threshold_pct))
    vanished = yes((kind == "DESAPARICION") & (periods >= cfg.min_trend_periods))
    up, down = moved & yes(change > 0), (moved & yes(change < 0)) | vanished
    upward = yes((price_way == "ALZA") & price_kind.isin("TENDENCIA", "MOVIMIENTO_RECIENTE"))
    settled = yes(price_way.isin("BAJA", "ESTABLE") & price_kind.isin("TENDENCIA", "ESTABLE", "MOVIMIENTO_RECIENTE"))

    def signal(when, name, strength):
        strength = strength if isinstance(strength, Column) else F.lit(strength)
        return F.when(when, F.struct((name if isinstance(name, Column) else F.lit(name)).alias("type"), strength.alias("strength")))

    return F.array_compact(
        F.array(
            signal(yes(F.col("n") >= cfg.min_obs_for_dispersion) & (yes(spread >= cfg.high_dispersion_spread_pct) | yes(cv >= cfg.high_dispersion_cv)), "HIGH_PRICE_DISPERSION", "OBSERVADA"),
            signal(sellers.between(1, cfg.low_competition_max_sellers) & (F.coalesce("listings_without_seller", F.lit(0)) == 0), "LOW_COMPETITION", "OBSERVADA"),
            signal(sellers >= cfg.high_competition_min_sellers, "HIGH_COMPETITION", "OBSERVADA"),
            signal(yes((price_kind == "TENDENCIA") & price_way.isin("ALZA", "BAJA")), F.when(price_way == "ALZA", "PRICE_INCREASE").otherwise("PRICE_DECREASE"), "TENDENCIA"),
            signal(up | down, F.when(up, "SUPPLY_INCREASE").otherwise("SUPPLY_DECREASE"), kind),
            signal(down & (yes(kind == "DESAPARICION") | yes(change <= -cfg.shortage_supply_drop_pct)), "POSSIBLE_SHORTAGE", F.when(upward, "FUERTE").otherwise("MODERADA")),
            signal(up & yes(change >= cfg.saturation_supply_rise_pct) & ~yes(price_way == "ALZA"), "POSSIBLE_SATURATION", F.when(settled, "FUERTE").otherwise("MODERADA")),
            signal(yes(periods >= cfg.min_trend_periods) & (yes(kind == "APARICION") | yes((kind == "TENDENCIA") & (change >= cfg.emerging_growth_pct))), "EMERGING_PRODUCT", kind),
            signal(F.col("unusual").isNotNull(), "UNUSUAL_MARKET_EVENT", "OBSERVADA"),
        )
    )


def confidence_score(n: Column, sources: Column, strong_share: Column, outlier_share: Column, freshness: Column, failed: Column, geo: Column, between: Column) -> Column:
    """The points of a row; shares are null where no row is valid, flags are booleans."""
    def points(when, value):
        return F.when(F.coalesce(when, F.lit(False)), value).otherwise(0)

    return (
        F.when(n >= 10, 2).when(n >= 5, 1).otherwise(0) + points(sources >= 2, 1)
        + points(strong_share >= 0.8, 1) + points(strong_share < 0.5, -1) + points(outlier_share > 0.2, -1)
        + points(freshness == "ACTUAL", 1) + points(failed > 0, -1) + points(geo, -1) + points(between, -1)
    )


def confidence_factors(n: Column, sources: Column, strong_share: Column, outlier_share: Column, freshness: Column, failed: Column, geo: Column, between: Column, score: Column) -> Column:
    """Why a row has its points: an array of (delta, factor), the sum last."""
    def factor(when, delta, *text):
        parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(delta).cast("int").alias("delta"), F.concat(*parts).alias("factor")))

    count, many, strong = n.cast("string"), sources.cast("string"), percent_label(strong_share)
    return F.array_compact(
        F.array(
            factor(n >= 10, 2, "muestra de precios suficiente (n=", count, ")"), factor((n >= 5) & (n < 10), 1, "muestra de precios moderada (n=", count, ")"),
            factor(n < 5, 0, "muestra de precios pequeña (n=", count, " < 5): confianza forzada a LOW"),
            factor(sources >= 2, 1, many, " fuentes distintas"), factor(sources < 2, 0, many, " fuente(s)"),
            factor(strong_share >= 0.8, 1, "coincidencia de producto fuerte (", strong, " EXACT/HIGH)"), factor(strong_share < 0.5, -1, "coincidencia de producto mayoritariamente ambigua (", strong, " EXACT/HIGH)"),
            factor((strong_share >= 0.5) & (strong_share < 0.8), 0, "coincidencia de producto mixta (", strong, " EXACT/HIGH)"),
            factor(outlier_share > 0.2, -1, "proporción alta de outliers (", percent_label(outlier_share), ")"),
            factor(freshness == "ACTUAL", 1, "datos actuales"), factor(freshness == "ANTIGUA", 0, "datos antiguos: confianza forzada a LOW"),
            factor(freshness.isin("ENVEJECIDA", "SIN_DATOS"), 0, "actualidad de datos: ", freshness),
            factor(failed > 0, -1, failed.cast("string"), " fuente(s) fallida(s)"), factor(geo, -1, "diferencias geográficas importantes"), factor(between, -1, "inconsistencia de precios entre fuentes"),
            factor(F.lit(True), None, "puntuación ", score.cast("string"), "; HIGH >= 5 sin fuentes fallidas, MEDIUM >= 3"),
        )
    )


def confidence_level(score: Column, n: Column, freshness: Column, failed: Column) -> Column:
    low = (F.coalesce(n, F.lit(0)) < 5) | F.coalesce(freshness == "ANTIGUA", F.lit(False))
    return F.when(low, "LOW").when((score >= 5) & (failed == 0), "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def lower_confidence(own: Column, other: Column) -> Column:
    """The lower of two levels; an unknown other one changes nothing."""
    rank = lambda c: F.when(c == "LOW", 0).when(c == "MEDIUM", 1).when(c == "HIGH", 2)
    least = F.least(rank(own), F.coalesce(rank(other), F.lit(2)))
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), least + 1)


def freshness_status(age_days: Column, fresh: int = 7, stale: int = 30) -> Column:
    return F.when(age_days.isNull(), "SIN_DATOS").when(age_days <= fresh, "ACTUAL").when(age_days > stale, "ANTIGUA").otherwise("ENVEJECIDA")


def competitive_pressure(sellers: Column, listings: Column, cfg: MarketConfig) -> Column:
    return F.when(listings > 0, F.when(sellers >= cfg.high_competition_min_sellers, "ALTA").when(sellers <= cfg.low_competition_max_sellers, "BAJA").otherwise("MEDIA"))


def price_stability(cv: Column) -> Column:
    return F.when(cv < 0.10, "ESTABLE").when(cv < 0.25, "MODERADA").when(cv.isNotNull(), "INESTABLE")


def margin(median: Column, currency: Column, cost: float, cost_currency: str) -> Column:
    """A simulated margin over a reference cost in the market's own currency."""
    comparable = median.isNotNull() & (currency == cost_currency.upper())
    return F.struct(
        F.when(comparable, "CALCULADO").otherwise("DATO_NO_DISPONIBLE").alias("status"),
        F.when(median.isNull(), "sin mediana de precio de mercado").when(~F.coalesce(comparable, F.lit(False)), "moneda del coste distinta a la del mercado principal").alias("reason"),
        F.when(comparable, median - cost).alias("potential_margin_abs"), F.when(comparable & (median != 0), (median - cost) / median * 100).alias("potential_margin_pct_over_price"),
    )
