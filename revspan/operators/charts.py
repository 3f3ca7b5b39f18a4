"""Chart-ready shapes of the monthly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revspan.operators.waterfall import FLOWS, measurable_months


def waterfall_long(waterfall: DataFrame) -> DataFrame:
    """month_start, movement_type, amount."""
    return waterfall.unpivot(["month_start"], list(FLOWS), "movement_type", "amount")


def rates_long(rates: DataFrame) -> DataFrame:
    """month_start, metric, pct for the measurable months."""
    return measurable_months(rates).unpivot(
        ["month_start"], ["gross_mrr_churn_rate_pct", "net_mrr_churn_rate_pct"], "metric", "pct"
    )


def waterfall_stack(waterfall: DataFrame) -> DataFrame:
    """Stacked bars: expansion stands on new, churned hangs under contraction."""
    return waterfall.select(
        "month_start", "new_mrr",
        "expansion_mrr", F.col("new_mrr").alias("expansion_bottom"),
        "contraction_mrr",
        "churned_mrr", F.col("contraction_mrr").alias("churned_bottom"),
        "ending_mrr",
    )
