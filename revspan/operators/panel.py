"""The dense account x month views, for callers who want every cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from revspan.functions.calendar import months_from_to
from revspan.functions.money import no_money
from revspan.functions.movement import movement_type


def _cells(spans: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per known account and month. Reigns are laid end to end, so exploding them
    gives every month once: no grid, no join, no second shuffle."""
    month = F.col("month_start")
    live = month <= F.col("live_to")
    live_before = F.add_months(month, -1) <= F.col("live_to")
    return (
        spans.where(F.col("is_known") & (F.col("from_month") <= F.col("to_month")))
        .select("*", F.explode(months_from_to(F.col("from_month"), F.col("to_month")))
                .alias("month_start"))
        .select(
            "month_start", "account_id",
            F.when(live, F.col("mrr")).otherwise(no_money()).alias("mrr"),
            F.when(live, F.col("plan_tier")).alias("plan_tier"),
            *attributes,
            F.when(month == F.col("from_month"), F.col("entry_prior"))
            .when(live_before, F.col("mrr")).otherwise(no_money()).alias("prior_mrr"),
        )
    )


def account_month_panel(spans: DataFrame, attributes: Sequence[str] = ("industry",)) -> DataFrame:
    """month_start, account_id, mrr and plan_tier at the month's last day, attributes."""
    return _cells(spans, attributes).drop("prior_mrr")


def account_movements(spans: DataFrame) -> DataFrame:
    """Every account-month with its prior revenue, the change and the kind of movement."""
    current, prior = F.col("current_mrr"), F.col("prior_mrr")
    return (
        _cells(spans, ())
        .withColumnRenamed("mrr", "current_mrr")
        .select(
            "month_start", "account_id", "current_mrr", "prior_mrr",
            (current - prior).alias("mrr_delta"),
            movement_type(prior, current).alias("movement_type"),
        )
    )
