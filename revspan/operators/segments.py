"""Segment breakdowns: lifetime logo churn and monthly revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.functions.calendar import Calendar
from revspan.functions.money import mean_amount, no_money, percent
from revspan.operators.spans import is_live, is_opening, span_edges
from revspan.operators.steps import step_series


def _churn_counts(accounts: DataFrame, *keys: str) -> DataFrame:
    """A NULL flag counts as not churned; a NULL segment is a group of its own."""
    churned = F.sum(F.when(F.col("churn_flag"), 1).otherwise(0)).cast("bigint")
    return (
        accounts.groupBy(*keys)
        .agg(F.count("*").alias("n_accounts"), churned.alias("n_churned"))
        .withColumn("churn_rate_pct", percent(F.col("n_churned"), F.col("n_accounts"), 1))
    )


def logo_churn(accounts: DataFrame, segment: str) -> DataFrame:
    """Ever-churned share of accounts by one account attribute."""
    return _churn_counts(accounts, segment)


def logo_churn_by_dimension(accounts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The same for several attributes in one pass: dimension, segment, counts, rate."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment"))
        for d in dimensions
    ]))
    return _churn_counts(accounts.select("churn_flag", pairs), "dimension", "segment")


def monthly_mrr_by_tier(spans: DataFrame, calendar: Calendar) -> DataFrame:
    """Revenue by the tier held at month end. A zero-amount subscription counts as active;
    a tier without any subscription in a month has no row there."""
    changes = span_edges(
        spans.where(F.col("plan_tier").isNotNull()), ["plan_tier"],
        {"active_accounts": F.lit(1).cast("bigint"), "total_mrr": F.col("mrr")},
    )
    series = step_series(changes, ["plan_tier"], ["active_accounts", "total_mrr"], calendar)
    return series.where(F.col("active_accounts") > 0).select(
        "month_start", "plan_tier", "active_accounts", "total_mrr",
        mean_amount(F.col("total_mrr"), F.col("active_accounts")).alias("avg_mrr_per_account"),
    )


def monthly_mrr_by_attribute(spans: DataFrame, calendar: Calendar, attribute: str) -> DataFrame:
    """Revenue by a fixed account attribute. Only paying accounts are active, and every
    segment has every month."""
    paying = F.col("mrr") > 0
    measures = {
        "active_accounts": paying.cast("bigint"),
        "total_mrr": F.col("mrr"),
        "paid_mrr": F.when(paying, F.col("mrr")).otherwise(no_money()),
    }
    changes = span_edges(spans, [attribute], measures, with_openings=True)
    return step_series(changes, [attribute], list(measures), calendar).select(
        "month_start", attribute, "active_accounts", "total_mrr",
        mean_amount(F.col("paid_mrr"), F.col("active_accounts")).alias("avg_mrr_per_account"),
    )


def monthly_mrr_by_dimension(spans: DataFrame, calendar: Calendar, tier: str, attribute: str) -> DataFrame:
    """Monthly revenue by tier and by account attribute from one scan of the spans: dimension, segment,
    month_start, active_accounts, total_mrr.

    Each reign gives its edges for both dimensions, so one keyed step series serves them: the tier counts
    every live reign that has one, the attribute only paying ones, and an opening row holds
    the attribute's place from the first calendar month.
    """
    live, one, none = is_live(), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    paying = F.when(F.col("mrr") > 0, one).otherwise(none)
    of_tier = live & F.col("plan_tier").isNotNull()
    of_attribute = live | is_opening()

    def edge(dimension: str, column: str, wanted: Column, active: Column, sign: int) -> Column:
        month = F.col("from_month") if sign > 0 else F.add_months("live_to", 1)
        return F.when(wanted, F.struct(
            F.lit(dimension).alias("dimension"), F.col(column).cast("string").alias("segment"),
            month.alias("month_start"), (active * sign).alias("active_accounts"),
            (F.col("mrr") if sign > 0 else -F.col("mrr")).alias("total_mrr"),
            (one * sign if dimension == tier else none).alias("held"),
        ))

    edges = F.filter(F.array(*[
        edge(dimension, column, wanted, active, sign)
        for dimension, column, wanted, active in (
            (tier, "plan_tier", of_tier, one), (attribute, attribute, of_attribute, paying))
        for sign in (1, -1)
    ]), lambda e: e.isNotNull())
    changes = spans.where(F.col("is_known") & of_attribute).select(F.inline(edges))
    keys, measures = ["dimension", "segment"], ["active_accounts", "total_mrr", "held"]
    series = step_series(changes, keys, measures, calendar)
    return series.where((F.col("dimension") != tier) | (F.col("held") > 0)).drop("held")


def segment_domain(churn: DataFrame) -> DataFrame:
    """The values a segment filter offers."""
    return churn.where(F.col("segment").isNotNull()).select("dimension", "segment").distinct()


def segment_comparison(churn: DataFrame) -> DataFrame:
    """Churn bars side by side: ``position`` ranks each dimension's segments, worst first.
    The rows are aggregated already, one per segment."""
    worst_first = Window.partitionBy("dimension").orderBy(
        F.col("churn_rate_pct").desc(), F.col("segment").asc_nulls_last()
    )
    return churn.withColumn("position", F.row_number().over(worst_first))


def segment_churn_series(churn: DataFrame, dimension: str) -> DataFrame:
    """The bars of one dimension."""
    return segment_comparison(churn.where(F.col("dimension") == dimension)).drop("dimension")
