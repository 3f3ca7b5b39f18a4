"""Growth percentages that refuse to divide by a tiny base."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revspan.functions.money import percent_label, rounded_ratio

# The smallest base a growth rate is computed from, and the text shown instead.
MIN_GROWTH_BASE = 2000
GROWTH_UNAVAILABLE = "n/a (base too small)"


def guarded_growth_pct(start: Column, end: Column, min_base: float = MIN_GROWTH_BASE) -> Column:
    """Percent change; NULL if the base is NULL or below ``min_base``."""
    return F.when(start >= F.lit(min_base), rounded_ratio(end - start, start, 100, 8))


def growth_label(pct: Column) -> Column:
    return F.coalesce(percent_label(pct), F.lit(GROWTH_UNAVAILABLE))
