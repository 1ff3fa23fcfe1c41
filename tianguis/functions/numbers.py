"""Rounding and number labels as the contract prints them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def round_exact(v: pd.Series, digits: pd.Series) -> pd.Series:
    """Half-even on the exact binary value. For the few rows of a result; never in a scan."""
    return pd.Series([None if pd.isna(x) else round(float(x), int(d)) for x, d in zip(v, digits)], dtype="float64")


def rounded(c: Column, digits: int) -> Column:
    return round_exact(c, F.lit(digits))


def short_number(c: Column) -> Column:
    """Six significant digits without closing zeros, for magnitudes from 0.0001 to below a million."""
    out = F.format_string("%.0f", c)
    for below, places in ((1e5, 1), (1e4, 2), (1e3, 3), (1e2, 4), (1e1, 5), (1.0, 6), (0.1, 7), (0.01, 8), (0.001, 9)):
        out = F.when(F.abs(c) < below, F.format_string(f"%.{places}f", c)).otherwise(out)
    return F.when(out.contains("."), F.regexp_replace(out, r"\.?0+$", "")).otherwise(out)


def percent_label(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
