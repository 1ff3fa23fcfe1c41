"""Thresholds of the market analysis, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MarketConfig:
    granularity: str = "week"
    include_medium_matches: bool = True
    min_obs_per_period: int = 3
    min_trend_periods: int = 3
    min_obs_for_dispersion: int = 4
    min_periods_unusual_event: int = 5
    price_change_threshold_pct: float = 10.0
    supply_change_threshold_pct: float = 20.0
    shortage_supply_drop_pct: float = 30.0
    saturation_supply_rise_pct: float = 30.0
    emerging_growth_pct: float = 100.0
    high_dispersion_spread_pct: float = 50.0
    high_dispersion_cv: float = 0.25
    low_competition_max_sellers: int = 2
    high_competition_min_sellers: int = 10
    availability_low_max: int = 3
    availability_medium_max: int = 10
    geo_difference_pct: float = 25.0
    source_difference_pct: float = 30.0
    fresh_days: int = 7
    stale_days: int = 30
    listing_max_age_days: int = 60
    min_bucket_n: int = 3
    clock_tolerance_minutes: int = 5
