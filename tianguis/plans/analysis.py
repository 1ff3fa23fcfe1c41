"""The whole market analysis of many targets in one plan.

``analyze`` gives tables, one concern each, keyed by target; ``contracts`` puts them together
as one nested JSON document a target. Thresholds that read rounded figures (gaps, spreads,
conversions, series) read them rounded here too, on tables of a few rows a target.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.config import MarketConfig
from tianguis.functions.numbers import rounded, short_number
from tianguis.functions.units import known
from tianguis.operators import dedup, rates, signals, stats, temporal
from tianguis.operators.components import Scratch, durable
from tianguis.operators.matching import RANK, matched, prepare_targets

ENGINE = "1.0.0"
T = ["target_id"]


@dataclass
class Analysis:
    """The tables of an analysis, each with ``target_id``."""

    targets: DataFrame
    records: DataFrame  # every relevant capture with its state; the trace
    weak_duplicates: DataFrame
    price_statistics: DataFrame  # a row a currency
    unit_price_statistics: DataFrame  # a row a currency and dimension
    breakdown: DataFrame
    gaps: DataFrame
    converted: DataFrame
    supply: DataFrame
    concentration: DataFrame
    supply_counts: DataFrame
    periods: DataFrame
    price_trends: DataFrame
    supply_trends: DataFrame
    sources: DataFrame
    issues: DataFrame
    wide: DataFrame  # a row a target: figures, freshness, signals, confidence, indicators

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _ts(value) -> Column:
    return F.lit(value).cast("timestamp")


def window_start(end: Column, granularity: str) -> Column:
    """By default as long before the end as the period that holds the end is long."""
    start = temporal.period_start(end, granularity)
    return end - (temporal.period_end(start, granularity) - start)


# What later steps read of a record besides its state; the rest is for the trace.
READ = (
    "target_id row_uid observation_id source_id source_name title_norm seller_norm province_norm availability_norm price currency_norm price_valid unit_price presentation "
    "presentation_status match_rank match_level injected captured_at published_at usable in_window time_reason period"
).split()
# What strong keys read besides.
KEYED = ["url_norm", "listing_id", "image_id"]
#: Replicated rows that are broadcast, at most.
REPLICATED = 200_000


def records(targets: DataFrame, obs: DataFrame, cfg: MarketConfig, start: Column, end: Column, now: Column, prefilter: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every pair of target and capture with its state; these without what only the trace shows; the weak duplicate groups of the window.

    Captures are written once as a compressed table. States are worked out on the columns in
    READ and joined to the others where a reader asks for them; where texts had to be
    worked out row by row, pairs are written whole in place of the captures.
    """
    held, steps, given = (Scratch(obs.sparkSession) for _ in range(3))
    found, few = matched(prepare_targets(targets), given.keep(obs), held, prefilter)
    at, late = F.col("captured_at"), F.col("captured_at") > now + F.make_dt_interval(mins=F.lit(cfg.clock_tolerance_minutes))
    outside = (F.size("t_provinces") > 0) & ~F.coalesce(F.array_contains("t_provinces", F.col("province_norm")), F.lit(False))
    measured = known(F.col("presentation")) & (~known(F.col("t_presentation")) | (F.col("presentation.dimension") == F.col("t_presentation.dimension")))
    found = found.withColumns(
        {
            "usable": at.isNotNull() & ~late,
            "in_window": F.coalesce(at.isNotNull() & ~late & at.between(start, end), F.lit(False)),
            "time_reason": F.when(at.isNull(), "sin timestamp de captura").when(late, "timestamp de captura en el futuro"),
            "period": F.when(at.isNotNull() & ~late & (at <= end), temporal.period_start(at, cfg.granularity)),
            "_outside": outside, "_measured": measured,
        }
    )
    if few:
        placed = held.keep(found.select(*READ, *KEYED, "_outside", "_measured"))
    else:
        found = placed = held.keep(found)
        given.drop()
    # the window and every period are scopes of their own, all in one pass
    scopes = placed.select("*", F.explode(F.array_compact(F.array(F.when(F.col("in_window"), F.lit("window")), F.date_format("period", "yyyy-MM-dd")))).alias("scope"))
    unique = dedup.replicated(scopes, ["target_id", "scope"], steps)
    inside = F.col("scope") == "window"

    def of_window(column: str) -> Column:
        return F.first(F.when(inside, F.col(column)), ignorenulls=True)

    unique = unique.groupBy("target_id", "row_uid").agg(
        of_window("is_canonical").alias("in_unique"), of_window("canonical_id").alias("duplicate_of"), of_window("duplicate_reasons").alias("duplicate_reasons"),
        F.first(F.when(~inside, F.col("is_canonical")), ignorenulls=True).alias("period_unique"),
    )
    unique = steps.keep(unique)
    if unique.count() <= REPLICATED:
        unique = F.broadcast(unique)
    r = placed.select(*READ, "_outside", "_measured").join(unique, ["target_id", "row_uid"], "left")
    # a row that is not replicated in a scope stays in it
    r = steps.keep(r.withColumns({"in_unique": F.coalesce("in_unique", "in_window"), "period_unique": F.coalesce("period_unique", F.col("period").isNotNull())}))
    first = F.col("in_unique")
    weak = F.col("match_rank") < RANK["MEDIUM"]
    outside = F.col("_outside")
    offered = first & ~weak & ~outside
    priced = offered & F.col("price_valid") & F.col("currency_norm").isNotNull() & (F.col("match_rank") >= RANK["MEDIUM" if cfg.include_medium_matches else "HIGH"])
    fits = F.col("presentation_status").isin("MISMA", "NO_ESPECIFICADA")
    r = r.withColumns(
        {
            "weak_match": first & weak, "out_of_scope": first & outside, "in_scope": ~outside, "in_supply": offered, "in_price_stats": priced & fits, "in_unit_price_stats": priced & F.col("_measured"),
            "exclusion_reasons": F.array_compact(
                F.array(
                    F.col("time_reason"), F.when(first & weak, F.concat(F.lit("coincidencia "), F.col("match_level"))),
                    F.when(first & outside, F.when(F.col("province_norm").isNull(), "provincia desconocida").otherwise("fuera del ámbito geográfico solicitado")),
                    F.when(offered & ~F.col("price_valid"), "precio ausente o inválido"), F.when(offered & F.col("currency_norm").isNull(), "moneda desconocida o ambigua"),
                )
            ),
        }
    )
    state = (
        F.when(~F.col("usable"), "excluida").when(~F.col("in_window"), F.when(at < start, "historico").otherwise("fuera_de_periodo")).when(~first, "duplicado")
        .when(~F.col("in_supply"), "excluida").when(F.col("in_price_stats") | F.col("in_unit_price_stats"), "valida").otherwise("solo_oferta")
    )
    dropped = F.col("in_window") & ~first
    r = r.withColumns({"status": state, "duplicate_of": F.when(dropped, F.col("duplicate_of")), "duplicate_reasons": F.when(dropped, F.col("duplicate_reasons")).otherwise(F.array().cast("array<string>"))})
    r = r.withColumns({"_p": F.when(F.col("in_price_stats"), F.col("price")), "_u": F.when(F.col("in_unit_price_stats"), F.col("unit_price")), "_pc": F.when(F.col("in_price_stats"), F.col("currency_norm")),
                       "_uc": F.when(F.col("in_unit_price_stats"), F.col("currency_norm")), "_ud": F.when(F.col("in_unit_price_stats"), F.col("presentation.dimension"))})
    r = stats.outliers(r, ["target_id", "_pc"], "_p", "outlier", first=True)
    r = stats.outliers(r, ["target_id", "_uc", "_ud"], "_u", "unit_outlier", first=True).drop("_p", "_u", "_pc", "_uc", "_ud", "_outside", "_measured")
    r = r.withColumns({"used_in_price_stats": F.col("in_price_stats") & F.col("outlier").isNull(), "used_in_unit_price_stats": F.col("in_unit_price_stats") & F.col("unit_outlier").isNull()})
    r = held.keep(r)
    steps.drop()
    whole = found.drop("_outside", "_measured", *[c for c in READ if c not in ("target_id", "row_uid")]).join(r, ["target_id", "row_uid"])
    return whole, r, dedup.weak_duplicates(r.where("in_unique"), T)


def _round_summary(df: DataFrame, digits: int) -> DataFrame:
    places = {"price_min": digits, "price_max": digits, "price_mean": digits, "price_median": digits, "price_range": digits, "price_spread_pct": 1, "p25": digits, "p75": digits, "iqr": digits, "coefficient_of_variation": 3}
    return df.withColumns({c: rounded(F.col(c), d) for c, d in places.items()})


def price_tables(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By currency; by currency and dimension; by currency and province or source."""
    by = ["target_id", "currency_norm"]
    priced, measured = r.where("in_price_stats"), r.where("in_unit_price_stats").withColumn("dimension", F.col("presentation.dimension"))
    currencies = priced.select(*by).union(measured.select(*by)).distinct()
    clean = priced.where("used_in_price_stats")
    levels = clean.groupBy(*by, "match_level").agg(F.count("*").alias("k")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_level", "k")))).alias("match_levels"))
    out = priced.groupBy(*by).agg((F.count("*") - F.count_if(F.col("used_in_price_stats"))).alias("outliers_excluded"), F.count("*").alias("group_n"), F.first("outlier_method").alias("outlier_method"))
    prices = currencies.join(out, by, "left").join(_round_summary(stats.price_summary(clean, by), 2), by, "left").join(levels, by, "left")
    prices = prices.fillna(0, ["n", "outliers_excluded", "group_n"])
    per = [*by, "dimension"]
    std = F.first("presentation.standard_unit").alias("standard_unit")
    labels = F.array_sort(F.collect_set(F.when(F.col("used_in_unit_price_stats"), F.concat(short_number(F.col("presentation.standard_quantity")), F.lit(" "), F.col("presentation.standard_unit")))))
    unit = measured.groupBy(*per).agg(std, (F.count("*") - F.count_if(F.col("used_in_unit_price_stats"))).alias("outliers_excluded"), labels.alias("presentations_included"), F.first("unit_outlier_method").alias("outlier_method"))
    unit = unit.join(_round_summary(stats.price_summary(measured.where("used_in_unit_price_stats"), per, "unit_price"), 4), per, "left").fillna(0, ["n"])
    parts = stats.breakdown(clean.withColumn("province", F.col("province_norm")), by, ["province", "source_id"])
    parts = parts.withColumns({c: rounded(F.col(c), 2) for c in ("price_median", "price_min", "price_max")})
    return prices, unit, parts


def trends(r: DataFrame, cfg: MarketConfig, end: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Periods; price series by currency; listing and seller series over sources captured throughout."""
    used = r.where(F.col("usable") & F.col("period").isNotNull())
    matched = used.where(F.col("period_unique") & (F.col("match_rank") >= RANK["MEDIUM"]) & F.col("in_scope"))
    at = ["target_id", "period"]
    level = RANK["MEDIUM" if cfg.include_medium_matches else "HIGH"]
    priced = matched.where(F.col("price_valid") & F.col("currency_norm").isNotNull() & F.col("presentation_status").isin("MISMA", "NO_ESPECIFICADA") & (F.col("match_rank") >= level))
    judged = stats.outliers(priced.select(*at, "currency_norm", "price"), [*at, "currency_norm"], "price", "o")
    clean = F.when(F.col("o").isNull(), F.col("price"))
    medians = judged.groupBy(*at, "currency_norm").agg(F.count("*").alias("price_n"), F.when(F.count(clean) >= cfg.min_obs_per_period, F.median(clean)).alias("m"))
    medians = durable(medians.withColumn("price_median", rounded(F.col("m"), 2)).drop("m"))
    captured = used.groupBy(*at).agg(F.array_sort(F.collect_set("source_id")).alias("sources_captured"))
    counted = matched.groupBy(*at).agg(F.count("*").alias("listing_count"), F.countDistinct("seller_norm").alias("seller_count"))
    prices = medians.groupBy(*at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency_norm", "price_median")))).alias("price_median"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency_norm", "price_n")))).alias("price_n"))
    period_end = temporal.period_end(F.col("period"), cfg.granularity)
    periods = durable(
        captured.join(counted, at, "left").join(prices, at, "left").fillna(0, ["listing_count", "seller_count"]).withColumn("period_end", period_end).withColumn("complete", F.col("period_end") <= end)
    )
    every = periods.select(*at).join(medians.select("target_id", "currency_norm").distinct(), "target_id")
    series = temporal.series(every.join(medians, [*at, "currency_norm"], "left"), ["target_id", "currency_norm"], "period", "price_median")
    price = series.withColumn("trend", temporal.classify(F.col("series"), cfg.price_change_threshold_pct, cfg.min_trend_periods)).withColumn("unusual", temporal.unusual(F.col("series"), cfg.min_periods_unusual_event))
    done = periods.where("complete").select(*at)
    common = durable(temporal.common_sources(used.join(done, at, "left_semi"), T, "period"))
    stable = matched.join(done, at, "left_semi").join(common, ["target_id", "source_id"], "left_semi")
    both = stable.groupBy(*at).agg(F.count("*").alias("listings"), F.countDistinct("seller_norm").alias("sellers"))
    filled = done.join(common.select("target_id").distinct(), "target_id", "left_semi").join(both, at, "left").fillna(0, ["listings", "sellers"])
    none = F.array().cast("array<double>")
    listing, seller = temporal.series(filled, T, "period", "listings"), temporal.series(filled, T, "period", "sellers")
    sources = common.groupBy("target_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources_used"))
    supply = periods.select("target_id").distinct().join(listing.withColumnRenamed("series", "l"), T, "left").join(seller.withColumnRenamed("series", "s"), T, "left").join(sources, T, "left")
    threshold, least = cfg.supply_change_threshold_pct, cfg.min_trend_periods
    supply = supply.select(
        "target_id", F.coalesce("sources_used", F.array().cast("array<string>")).alias("sources_used"),
        temporal.classify(F.coalesce("l", none), threshold, least).alias("listing_trend"), temporal.classify(F.coalesce("s", none), threshold, least).alias("seller_trend"),
    )
    return periods, price, supply


def source_table(r: DataFrame, status: DataFrame | None) -> DataFrame:
    """What each source gave and how it went; a source of many is credited with what it returned."""
    seen = r.groupBy("target_id", "source_id").agg(
        F.min("source_name").alias("seen_name"), F.count("*").alias("observations_received"), F.min("captured_at").alias("captured_at_min"), F.max("captured_at").alias("captured_at_max"),
        F.count_if(F.col("in_price_stats") | F.col("in_unit_price_stats")).alias("observations_used_in_price_stats"),
    )
    if status is None:
        return seen.select("target_id", "source_id", F.col("seen_name").alias("source_name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), *seen.columns[3:])
    own = F.filter(F.coalesce("source_ids_returned", F.array().cast("array<string>")), lambda s: s != F.col("source_id"))
    stated = status.select(F.explode(F.when(F.size(own) > 0, own).otherwise(F.array("source_id"))).alias("sid"), "source_id", F.coalesce("status", F.lit("ok")).alias("status"), "error", "source_name")
    stated = stated.select(F.col("sid").alias("source_id"), "status", "error", F.when(F.col("sid") == F.col("source_id"), F.col("source_name")).alias("given_name"))
    each = r.select("target_id").distinct().join(F.broadcast(stated), F.lit(True))
    out = each.join(seen, ["target_id", "source_id"], "full")
    return out.select(
        "target_id", "source_id", F.coalesce("given_name", "seen_name").alias("source_name"), F.coalesce("status", F.lit("ok")).alias("status"), "error",
        F.coalesce("observations_received", F.lit(0)).alias("observations_received"), "captured_at_min", "captured_at_max", F.coalesce("observations_used_in_price_stats", F.lit(0)).alias("observations_used_in_price_stats"),
    )


def record_issues(r: DataFrame, cfg: MarketConfig, now: Column) -> DataFrame:
    """The issues that rows show, long: a row a target and code, ids up to 25."""
    old = F.floor((F.unix_micros(now) - F.unix_micros("published_at")) / 86400e6) > cfg.listing_max_age_days
    rules = [
        (1, "SIN_TIMESTAMP_CAPTURA", "ALTA", F.col("captured_at").isNull(), True), (2, "TIMESTAMP_FUTURO", "ALTA", F.col("captured_at").isNotNull() & ~F.col("usable"), True),
        (3, "POSIBLE_INYECCION_DE_INSTRUCCIONES", "MEDIA", F.col("injected"), True), (4, "DUPLICADOS", "INFO", F.col("status") == "duplicado", True),
        (6, "PRECIO_INVALIDO", "MEDIA", F.col("in_supply") & ~F.col("price_valid"), False), (7, "MONEDA_DESCONOCIDA", "MEDIA", F.col("in_supply") & F.col("currency_norm").isNull(), False),
        (8, "PRODUCTO_AMBIGUO", "MEDIA", F.col("in_unique") & (F.col("match_level") == "MEDIUM"), True), (9, "UNIDAD_DESCONOCIDA", "MEDIA", F.col("in_supply") & ~known(F.col("presentation")), True),
        (10, "POSIBLES_OUTLIERS", "MEDIA", F.col("outlier").isNotNull() | F.col("unit_outlier").isNotNull(), True), (17, "ANUNCIOS_ANTIGUOS", "BAJA", F.col("in_window") & F.coalesce(old, F.lit(False)), True),
    ]
    # one pass: every row names its issues, then they are counted
    named = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(ids).alias("ids"))) for seq, code, sev, when, ids in rules]))
    each = r.select("target_id", "row_uid", "observation_id", F.explode(named).alias("i")).select("target_id", "row_uid", "observation_id", "i.*")
    count = each.groupBy("target_id", "seq", "code", "severity", "ids").agg(F.count("*").alias("count"))
    first = _first_ids(each.where("ids"), 25)
    none = F.array().cast("array<string>")
    return count.join(first, ["target_id", "seq"], "left").select("target_id", "seq", "code", "severity", "count", F.coalesce("observation_ids", none).alias("observation_ids"))


def _first_ids(each: DataFrame, k: int, lots: int = 64) -> DataFrame:
    """The ids of the ``k`` first rows by target and issue: the first ``k`` of each lot, then of those."""
    from pyspark.sql import Window

    keys = ["target_id", "seq"]
    dealt = each.withColumn("lot", F.pmod(F.xxhash64("row_uid"), F.lit(lots)))
    near = dealt.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "lot").orderBy("row_uid"))).where(F.col("k") <= k)
    return near.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("row_uid", "observation_id"))), 1, k)["observation_id"].alias("observation_ids"))


def analyze(
    targets: DataFrame, observations: DataFrame, *, analysis_end, analysis_start=None, now=None, rates_table: DataFrame | None = None, convert_to: str | None = None,
    reference_cost: tuple[float, str] | None = None, source_status: DataFrame | None = None, cfg: MarketConfig | None = None, prefilter: bool = True,
) -> Analysis:
    """Analyses the observations (schema.OBSERVATION with ``row_uid``) for every target.

    Currencies are never mixed; without a dated rate nothing is converted. Observations that
    have nothing in common with a target are not its records; without ``prefilter`` they are,
    as excluded ones. An empty input gives tables without rows, but a ``wide`` row a target.
    """
    cfg = cfg or MarketConfig()
    end = _ts(analysis_end)
    now = _ts(now if now is not None else analysis_end)
    start = _ts(analysis_start) if analysis_start is not None else window_start(end, cfg.granularity)
    prepared = durable(prepare_targets(targets))
    whole, r, weak = records(targets, observations, cfg, start, end, now, prefilter)
    prices, unit, parts = (durable(t) for t in price_tables(r))
    best = prices.groupBy("target_id").agg(F.min(F.struct((-F.col("group_n")).alias("n"), F.col("currency_norm").alias("c"))).alias("b")).select("target_id", F.col("b.c").alias("primary_currency"))
    main = prices.join(best, (prices.target_id == best.target_id) & (prices.currency_norm == best.primary_currency)).drop(best.target_id)
    dimension = prepared.select("target_id", F.when(known(F.col("t_presentation")), F.col("t_presentation.dimension")).alias("dimension"))
    spare = unit.where("n > 0").join(dimension, ["target_id", "dimension"]).select("target_id", "currency_norm", F.struct("n", *SUMMARY).alias("u"))
    main = main.join(spare, ["target_id", "currency_norm"], "left")
    main = main.select("target_id", "primary_currency", *[F.when((F.col("n") == 0) & F.col("u").isNotNull(), F.col("u")[c]).otherwise(F.col(c)).alias(c) for c in ("n", *SUMMARY)])
    at_main = parts.join(best, (parts.target_id == best.target_id) & (parts.currency_norm == best.primary_currency)).drop(best.target_id)
    gaps = None
    for name, exclude in (("province", ("desconocida",)), ("source_id", ())):
        g = stats.max_gap(at_main.where(F.col("dimension") == name), T, cfg.min_bucket_n, exclude).withColumn("gap_pct", rounded(F.col("gap_pct"), 1)).withColumn("dimension", F.lit(name))
        gaps = g if gaps is None else gaps.unionByName(g)
    gaps = durable(gaps)
    offered = r.where("in_supply")
    supply = durable(stats.supply(offered, T, cfg.availability_low_max, cfg.availability_medium_max))
    held = stats.concentration(offered, T)
    held = durable(held.withColumns({"hhi": rounded(F.col("hhi"), 0), "top_seller_share_pct": rounded(F.col("top_seller_share_pct"), 1)}))
    counts = stats.breakdown(offered.withColumn("province", F.col("province_norm")).withColumn("price", F.lit(0.0)), T, ["province", "source_id"]).select("target_id", "dimension", "bucket", "n")
    periods, price_trends, supply_trends = trends(r, cfg, end)
    price_trends, supply_trends = durable(price_trends), durable(supply_trends)
    sources = durable(source_table(r, source_status))
    if convert_to and rates_table is not None:
        picked = rates.picked_rates(rates_table, convert_to)
        foreign = prices.where(F.col("currency_norm") != convert_to.upper()).join(F.broadcast(picked), F.col("currency_norm") == F.col("currency"), "left")
        factor = F.col("factor")
        converted = foreign.select(
            "target_id", "currency_norm", F.lit(convert_to.upper()).alias("target_currency"), factor.alias("rate"), "rate_as_of", "rate_source", "n",
            *[rounded(F.col(c) * factor, 2).alias(c) for c in ("price_median", "price_min", "price_max")], F.when(factor.isNull(), "DATO_NO_DISPONIBLE").otherwise("ESTIMACION").alias("status"),
        )
    else:
        converted = prices.select("target_id", "currency_norm", F.lit(convert_to).cast("string").alias("target_currency")).where("false")
    header = r.groupBy("target_id").agg(
        F.count("*").alias("observation_count_total"), F.count_if(F.col("in_window")).alias("observation_count"), F.count_if(F.col("in_unique")).alias("unique_observation_count"),
        F.count_if(F.col("in_price_stats") | F.col("in_unit_price_stats")).alias("valid_price_observation_count"), F.min(F.when(F.col("in_window"), F.col("captured_at"))).alias("captured_at_min"),
        F.max(F.when(F.col("in_window"), F.col("captured_at"))).alias("captured_at_max"), F.count_if(F.col("status") == "duplicado").alias("duplicates_removed"),
        F.count_if(F.col("outlier").isNotNull() | F.col("unit_outlier").isNotNull()).alias("outliers_flagged"), F.count_if(F.col("out_of_scope")).alias("excluded_out_of_scope"),
        F.count_if(F.col("weak_match") & (F.col("match_level") == "LOW")).alias("excluded_match_low"), F.count_if(F.col("weak_match") & (F.col("match_level") == "NO_MATCH")).alias("excluded_no_match"),
        F.count_if((F.col("in_price_stats") | F.col("in_unit_price_stats")) & F.col("match_level").isin("EXACT", "HIGH")).alias("strong"),
        F.count_if((F.col("in_price_stats") | F.col("in_unit_price_stats")) & (F.col("outlier").isNotNull() | F.col("unit_outlier").isNotNull())).alias("odd"),
    )
    own = price_trends.join(best, (price_trends.target_id == best.target_id) & (price_trends.currency_norm == best.primary_currency)).drop(best.target_id)
    failed = sources.groupBy("target_id").agg(F.count_if(F.col("status") == "error").alias("failed_sources"))
    gap = gaps.groupBy("target_id").agg(F.max(F.when(F.col("dimension") == "province", F.col("gap_pct"))).alias("geo_gap_pct"), F.max(F.when(F.col("dimension") == "source_id", F.col("gap_pct"))).alias("source_gap_pct"))
    wide = prepared.select("target_id")
    for part in (header, main, supply, held.select("target_id", "hhi", "top_seller_share_pct", F.col("level").alias("concentration_level")), own.select("target_id", F.col("trend").alias("price_trend"), "unusual"), supply_trends, failed, gap):
        wide = wide.join(part, T, "left")
    wide = wide.fillna(0, ["n", "observation_count_total", "observation_count", "unique_observation_count", "valid_price_observation_count", "duplicates_removed", "outliers_flagged", "listing_count",
                           "available_listing_count", "seller_count", "source_count", "listings_without_seller", "failed_sources", "strong", "odd", "excluded_out_of_scope", "excluded_match_low", "excluded_no_match"])
    wide = wide.fillna({"availability_level": "SIN_OFERTA_OBSERVADA"})
    age = (F.unix_micros(now) - F.unix_micros("captured_at_max")) / 86400e6
    wide = wide.withColumns({"age_days": age, "freshness": signals.freshness_status(age, cfg.fresh_days, cfg.stale_days)})
    valid, geo, between = F.nullif("valid_price_observation_count", F.lit(0)), F.coalesce(F.col("geo_gap_pct") >= cfg.geo_difference_pct, F.lit(False)), F.coalesce(F.col("source_gap_pct") >= cfg.source_difference_pct, F.lit(False))
    judged = (F.col("n"), F.col("source_count"), F.col("strong") / valid, F.col("odd") / valid, F.col("freshness"), F.col("failed_sources"), geo, between)
    score = signals.confidence_score(*judged)
    wide = wide.withColumns({"geo_difference": geo, "source_difference": between, "confidence_score": score, "confidence_factors": signals.confidence_factors(*judged, score), "signals": signals.signal_types(cfg)})
    money = prices.groupBy("target_id").agg(F.array_sort(F.collect_list("currency_norm")).alias("currencies"))
    seen = periods.groupBy("target_id").agg(F.count("*").alias("period_count"), F.max_by("complete", "period").alias("last_complete"))
    gone = converted.where("status = 'DATO_NO_DISPONIBLE'").groupBy("target_id").agg(F.array_sort(F.collect_list("currency_norm")).alias("unconverted")) if "status" in converted.columns else prices.select("target_id", F.array().cast("array<string>").alias("unconverted")).where("false")
    for part in (money, seen, gone, prepared.select("target_id", known(F.col("t_presentation")).alias("sized"))):
        wide = wide.join(part, T, "left")
    wide = wide.withColumn("limitations", limitations(cfg, convert_to, reference_cost)).drop("period_count", "last_complete", "unconverted", "sized")
    wide = wide.withColumns(
        {
            "confidence": signals.confidence_level(F.col("confidence_score"), F.col("n"), F.col("freshness"), F.col("failed_sources")),
            "competitive_pressure": signals.competitive_pressure(F.col("seller_count"), F.col("listing_count"), cfg), "price_stability": signals.price_stability(F.col("coefficient_of_variation")),
        }
    )
    if reference_cost is not None:
        wide = wide.withColumn("margin", signals.margin(F.col("price_median"), F.col("primary_currency"), float(reference_cost[0]), reference_cost[1]))
    wide = durable(wide)
    found = record_issues(r, cfg, now)

    def noted(seq, code, severity, when, count=None):
        return wide.where(when).select("target_id", F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (count if count is not None else F.lit(None)).cast("bigint").alias("count"), F.array().cast("array<string>").alias("observation_ids"))

    uneven = periods.where("complete").groupBy("target_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources_captured")))).alias("captured"))
    everything = periods.groupBy("target_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources_captured")))).alias("ever"))
    uneven = uneven.join(everything, T).join(supply_trends, T).where(F.col("ever") != F.col("sources_used")).select("target_id")
    groups = weak.groupBy("target_id").agg(F.count("*").alias("count"), F.slice(F.flatten(F.array_sort(F.collect_list("ids"))), 1, 25).alias("observation_ids"))
    found = found.unionByName(groups.select("target_id", F.lit(5).alias("seq"), F.lit("POSIBLES_DUPLICADOS").alias("code"), F.lit("BAJA").alias("severity"), "count", "observation_ids"))
    for extra in (
        noted(11, "DIFERENCIAS_GEOGRAFICAS", "MEDIA", F.col("geo_difference")), noted(12, "INCONSISTENCIA_ENTRE_FUENTES", "MEDIA", F.col("source_difference")),
        noted(13, "COBERTURA_VARIABLE_ENTRE_PERIODOS", "MEDIA", F.lit(True)).join(uneven, T, "left_semi"), noted(14, "FUENTE_FALLIDA", "ALTA", F.col("failed_sources") > 0, F.col("failed_sources")),
        noted(15, "FUENTES_INSUFICIENTES", "MEDIA", F.col("source_count") == 1), noted(16, "DATOS_ANTIGUOS", "ALTA", F.col("freshness") == "ANTIGUA"), noted(16, "DATOS_ANTIGUOS", "MEDIA", F.col("freshness") == "ENVEJECIDA"),
    ):
        found = found.unionByName(extra)
    return Analysis(prepared, whole, weak, prices, unit, parts, gaps, converted, supply, held, counts, periods, price_trends, supply_trends, sources, found, wide)


SUMMARY = ["price_min", "price_max", "price_mean", "price_median", "price_range", "price_spread_pct", "p25", "p75", "iqr", "coefficient_of_variation"]


def trace(a: Analysis) -> DataFrame:
    """Every record with raw and normalised values side by side and what it was used for."""
    return a.records.select(
        "target_id", "observation_id", "source_id", "url", "listing_id", "title", "seller", "province", "municipality", "captured_at",
        F.struct("price", F.col("currency").alias("raw_currency"), F.col("currency_norm").alias("currency")).alias("price"), "presentation", rounded(F.col("unit_price"), 4).alias("unit_price"),
        F.struct(F.col("availability").alias("raw_value"), F.col("availability_norm").alias("normalized_value")).alias("availability"),
        F.struct(F.col("match_level").alias("level"), rounded(F.col("token_coverage"), 3).alias("token_coverage"), "presentation_status", F.col("match_reasons").alias("reasons")).alias("match"),
        "status", "exclusion_reasons", "duplicate_of", "duplicate_reasons", "outlier", F.col("unit_outlier").alias("unit_price_outlier"), "used_in_price_stats", "used_in_unit_price_stats",
    )


def limitations(cfg: MarketConfig, convert_to: str | None, reference_cost: tuple[float, str] | None) -> Column:
    """What a reader of the figures has to bear in mind, in a fixed order."""
    def note(when, *text):
        return F.when(F.coalesce(when, F.lit(False)), F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]))

    periods, none = F.coalesce("period_count", F.lit(0)), F.array().cast("array<string>")
    missing = F.transform(F.coalesce("unconverted", none), lambda c: F.concat(F.lit("No hay tipo de cambio autorizado "), c, F.lit(f"->{(convert_to or '').upper()}; no se convierte.")))
    cost = F.lit(False) if reference_cost is None else F.col("price_median").isNotNull() & (F.col("primary_currency") != reference_cost[1].upper())
    return F.concat(
        F.array_compact(F.array(
            note(~F.col("sized"), "El producto objetivo no especifica presentación: los precios por anuncio pueden mezclar formatos; se prioriza el precio por unidad estándar."),
            note(F.size("currencies") > 1, "Precios observados en varias monedas (", F.array_join("currencies", ", "), "); se presentan como mercados monetarios separados."),
        )),
        missing,
        F.array_compact(F.array(
            note(~F.col("last_complete"), "El último periodo está incompleto; se excluye de las tendencias de anuncios y vendedores."),
            note(periods < cfg.min_trend_periods, "Histórico insuficiente para tendencias (", periods.cast("string"), f" periodo(s); se requieren {cfg.min_trend_periods})."),
            note(F.col("n") == 0, "No hay observaciones de precio válidas para el producto en el periodo analizado."),
            F.lit("La muestra representa únicamente el mercado observable en las fuentes consultadas, no la totalidad del mercado."),
            F.lit("No se dispone de datos de ventas reales: oferta y número de anuncios son proxies, no ventas."),
            note(cost, "El coste de referencia está en otra moneda que la mediana de mercado; no se simula margen."),
        )),
    )


def inspect(a: Analysis, target_id: str, status: str | None = None, match_level: str | None = None, only_outliers: bool = False, limit: int = 20) -> DataFrame:
    """A few traced records of a target, 1 to 50."""
    rows = trace(a).where(F.col("target_id") == target_id)
    if status:
        rows = rows.where(F.col("status") == status)
    if match_level:
        rows = rows.where(F.col("match.level") == match_level)
    if only_outliers:
        rows = rows.where(F.col("outlier").isNotNull() | F.col("unit_price_outlier").isNotNull())
    return rows.limit(max(1, min(50, limit)))


def summary_statements(row: DataFrame) -> Column:
    """What the figures say, as (type, text)."""
    def say(when, kind, text):
        return F.when(when, F.struct(F.lit(kind).alias("type"), text.alias("text")))

    def s(c):
        return F.col(c).cast("string")

    moved = F.coalesce(F.col("price_trend.classification") != "INSUFICIENTE", F.lit(False))
    return F.array_compact(
        F.array(
            say(F.lit(True), "HECHO_OBSERVADO", F.concat(F.lit("Se observaron "), s("listing_count"), F.lit(" anuncios coincidentes únicos de "), s("seller_count"), F.lit(" vendedor(es) identificado(s) en "), s("source_count"), F.lit(" fuente(s)."))),
            say(F.col("n") > 0, "ESTADISTICA_CALCULADA", F.concat(F.lit("Precio típico (mediana) "), s("price_median"), F.lit(" "), s("primary_currency"), F.lit("; rango "), s("price_min"), F.lit("–"), s("price_max"), F.lit(" (n="), s("n"), F.lit(", sin outliers)."))),
            say(F.col("n") == 0, "DATO_NO_DISPONIBLE", F.lit("No hay precios válidos suficientes para estimar un precio típico.")),
            say(moved, "ESTADISTICA_CALCULADA", F.concat(F.lit("Evolución de la mediana: "), F.col("price_trend.classification"), F.lit(" ("), F.coalesce("price_trend.direction", F.lit("-")), F.lit(")."))),
            say(~moved, "DATO_NO_DISPONIBLE", F.lit("Histórico insuficiente para evaluar la evolución del precio.")),
            say(F.size("signals") > 0, "INFERENCIA", F.concat(F.lit("Señales detectadas: "), F.array_join(F.col("signals.type"), ", "), F.lit("."))),
            say(F.lit(True), "DATO_NO_DISPONIBLE", F.lit("Ventas reales: no disponibles en las fuentes consultadas.")),
        )
    )


def contracts(a: Analysis) -> DataFrame:
    """``(target_id, analysis_id, contract)``: one JSON document a target, without the trace."""
    def listed(df, name, order):
        columns = [c for c in df.columns if c != "target_id"]
        rows = F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*columns).alias("v")))
        by_key = F.array_sort(rows, lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
        return df.groupBy("target_id").agg(by_key.alias("x")).select("target_id", F.col("x.v").alias(name))

    out = a.wide.withColumn("statements", summary_statements(a.wide))
    out = out.join(a.targets.select("target_id", F.struct(F.col("t_name").alias("name"), F.col("t_brand").alias("brand"), F.col("t_presentation").alias("presentation"), F.col("t_provinces").alias("geographic_scope")).alias("product")), "target_id")
    for table, name, order in (
        (a.price_statistics, "by_currency", ["currency_norm"]), (a.unit_price_statistics, "unit_price", ["currency_norm", "dimension"]), (a.breakdown, "breakdown", ["currency_norm", "dimension", "bucket"]),
        (a.converted, "converted", ["currency_norm"]), (a.periods, "periods", ["period"]), (a.price_trends, "price_trends", ["currency_norm"]), (a.sources, "sources", ["source_id"]), (a.issues, "issues", ["seq"]),
    ):
        out = out.join(listed(table, name, order), "target_id", "left")
    body = F.struct(F.lit(ENGINE).alias("engine_version"), *[c for c in out.columns if c != "target_id"])
    return out.select("target_id", F.concat(F.lit("an_"), F.substring(F.sha2(F.to_json(body), 256), 1, 12)).alias("analysis_id"), F.to_json(body).alias("contract"))


def merge_items(items: DataFrame, a: Analysis) -> tuple[DataFrame, DataFrame]:
    """Conclusions (``target_id, text, confidence``) joined to their analyses, and those without one.

    A confidence is only ever lowered; a text that reads like a decision is marked.
    """
    known_ = a.wide.select("target_id", F.col("confidence").alias("own_confidence"))
    out = items.join(known_, "target_id").withColumn("confidence", signals.lower_confidence(F.col("own_confidence"), F.col("confidence"))).drop("own_confidence")
    return out.withColumn("boundary_warning", reads_like_decision(F.col("text"))), items.join(known_, "target_id", "left_anti")


# Fixed value: how decisions, which are not this library's, are worded.
DECISION_SIGNS = (
    r"\b(?:deber[ií]a(?:mos|n)?|debe(?:mos|n)?|recomiendo|recomendamos|conviene)\s+"
    r"(?:comprar|vender|subir|bajar|dejar de|eliminar|retirar|reducir|aumentar)|"
    r"\b(?:es|ser[aá])\s+rentable\s+para\s+(?:el|nuestro|su)\s+negocio"
)


def reads_like_decision(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?iu){DECISION_SIGNS}"), F.lit(False))

