"""The same results in the shapes one would write first, for the bench to compare against.

The grid form builds every account-month, meets it with the cleaned intervals and compares
neighbouring months with LAG. It is also a second oracle in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from revspan.functions.calendar import (
    Calendar, last_month_covered, month_index_gap, month_of, months_from_to,
)
from revspan.functions.money import no_money, percent
from revspan.functions.movement import movement_type
from revspan.operators.cohorts import cohort_assignment, cohort_sizes


def lead_timeline(subscriptions: DataFrame) -> DataFrame:
    """One window over all rows of an account."""
    w = Window.partitionBy("account_id").orderBy("start_date", "subscription_id")
    return subscriptions.withColumn("next_start_date", F.lead("start_date").over(w)).withColumn(
        "effective_end_date", F.least("end_date", F.date_sub("next_start_date", 1))
    )


def _grid(accounts: DataFrame, calendar: Calendar) -> DataFrame:
    return accounts.select(
        "account_id", "industry",
        F.explode(months_from_to(calendar.first, calendar.last)).alias("month_start"),
    )


def panel_by_range_join(
    accounts: DataFrame, subscriptions: DataFrame, calendar: Calendar
) -> DataFrame:
    """Grid, interval-contains-month-end join, aggregate."""
    t = lead_timeline(subscriptions).select(
        F.col("account_id").alias("owner"), "start_date", "effective_end_date", "mrr_amount", "plan_tier"
    )
    month_end = F.last_day("month_start")
    active = (
        (F.col("account_id") == F.col("owner"))
        & (F.col("start_date") <= month_end)
        & (F.col("effective_end_date").isNull() | (F.col("effective_end_date") >= month_end))
    )
    return _grid(accounts, calendar).join(t, active, "left").groupBy(
        "month_start", "account_id", "industry"
    ).agg(
        F.coalesce(F.sum("mrr_amount"), no_money()).alias("mrr"),
        F.max("plan_tier").alias("plan_tier"),
    )


def panel_by_exploded_join(
    accounts: DataFrame, subscriptions: DataFrame, calendar: Calendar
) -> DataFrame:
    """Intervals exploded to their months, equi join with the grid."""
    last = F.least(last_month_covered(F.col("effective_end_date")), calendar.last)
    active = (
        lead_timeline(subscriptions)
        .withColumns({
            "first_month": F.greatest(month_of("start_date"), calendar.first), "last_month": last,
        })
        .where(F.col("first_month") <= F.col("last_month"))
        .select(
            "account_id", "mrr_amount", "plan_tier",
            F.explode(months_from_to(F.col("first_month"), F.col("last_month"))).alias("month_start"),
        )
    )
    return _grid(accounts, calendar).join(active, ["account_id", "month_start"], "left").select(
        "month_start", "account_id", "industry",
        F.coalesce("mrr_amount", no_money()).alias("mrr"), "plan_tier",
    )


def waterfall_by_lag(panel: DataFrame) -> DataFrame:
    """LAG over the dense panel, then the monthly sums."""
    w = Window.partitionBy("account_id").orderBy("month_start")
    prior = F.coalesce(F.lag("mrr").over(w), no_money())
    moves = panel.select("month_start", F.col("mrr").alias("current"), prior.alias("prior"))
    delta = F.col("current") - F.col("prior")
    kind = movement_type(F.col("prior"), F.col("current"))
    return moves.groupBy("month_start").agg(
        F.sum("prior").alias("starting_mrr"),
        *[F.sum(F.when(kind == k, delta).otherwise(no_money())).alias(f"{k}_mrr")
          for k in ("new", "expansion", "contraction", "churned")],
        F.sum("current").alias("ending_mrr"),
    )


def retention_by_panel(panel: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every panel cell joined to its cohort and counted."""
    cells = panel.join(cohort_assignment(subscriptions), "account_id").where(
        F.col("month_start") >= F.col("cohort_month")
    )
    months_since = month_index_gap(F.col("month_start"), F.col("cohort_month"))
    return (
        cells.groupBy("cohort_month", months_since.alias("months_since_signup"))
        .agg(F.count_if(F.col("mrr") > 0).alias("active_accounts"))
        .join(cohort_sizes(subscriptions), "cohort_month")
        .withColumn("retention_pct", percent(F.col("active_accounts"), F.col("cohort_size"), 1))
    )
