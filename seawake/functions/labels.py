"""Levels, labels and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def congestion_level(c: Column) -> Column:
    return F.when(c < 0.8, "below normal").when(c < 1.2, "normal").when(c < 1.6, "elevated").when(c.isNotNull(), "high")


def confidence(width: Column, fallback: Column) -> Column:
    return F.when((width <= 0.20) & (fallback <= 0.05), "high").when((width <= 0.40) | (fallback <= 0.20), "medium").otherwise("low")


def band(c: Column, p25: Column, p50: Column, p75: Column) -> Column:
    return F.when(c <= p25, "Low").when(c <= p50, "Moderate").when(c <= p75, "High").when(c.isNotNull(), "Very High")


def analog_confidence(tier: Column, n: Column) -> Column:
    return (
        F.when((tier == 1) & (n >= 4), "high").when((tier == 1) & (n >= 2), "medium").when((tier == 2) & (n >= 3), "high").when((tier == 2) & (n >= 2), "medium")
        .when((tier <= 4) & (n >= 3), "medium").when(n >= 5, "medium").otherwise("low")
    )


def percent_change(now: Column, base: Column, least_base: float) -> Column:
    """Null where the base is too small to divide by."""
    return F.when(F.abs(base) >= least_base, (now - base) / F.abs(base) * 100)


def share(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def mass_text(tonnes: Column) -> Column:
    """Tonnes with a unit that suits their size."""
    return (
        F.when(tonnes >= 1e6, F.concat(F.format_number(tonnes / 1e6, 2), F.lit(" Mt"))).when(tonnes >= 1e3, F.concat(F.format_number(tonnes / 1e3, 2), F.lit(" kt")))
        .otherwise(F.concat(F.format_number(tonnes, 2), F.lit(" t")))
    )
