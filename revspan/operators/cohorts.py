"""First-subscription cohorts and their retention triangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revspan.functions.calendar import Calendar, month_index_gap, month_of
from revspan.functions.money import percent
from revspan.operators.spans import is_live, is_opening
from revspan.operators.steps import step_series


def cohort_assignment(subscriptions: DataFrame) -> DataFrame:
    """account_id, cohort_month: anchored on the first subscription, not on signup."""
    return (
        subscriptions.groupBy("account_id")
        .agg(F.min("start_date").alias("first_sub_date"))
        .select("account_id", month_of("first_sub_date").alias("cohort_month"))
    )


def cohort_sizes(subscriptions: DataFrame) -> DataFrame:
    return cohort_assignment(subscriptions).groupBy("cohort_month").agg(
        F.count("*").alias("cohort_size")
    )


def cohort_retention(spans: DataFrame, calendar: Calendar) -> DataFrame:
    """Share of each cohort with revenue, for every calendar month from the cohort on.

    Cohort size and active accounts are two step functions of the same changes: the size
    steps up once, where the cohort's accounts first appear, and activity steps with the
    edges of paying reigns. Months in which nobody is active keep their row.
    """
    nothing = F.lit(0).cast("bigint")

    def edge(month: Column, active: Column) -> Column:
        return F.struct(
            month.alias("month_start"), active.alias("active_accounts"),
            nothing.alias("cohort_size"), nothing.alias("tracked"),
        )

    one = F.lit(1).cast("bigint")
    pays = F.col("is_known") & is_live() & (F.col("mrr") > 0)
    arrival = F.struct(
        F.greatest(F.col("cohort_month"), calendar.first).alias("month_start"),
        nothing.alias("active_accounts"),
        F.col("is_first").cast("bigint").alias("cohort_size"),
        (F.col("is_first") & F.col("is_known")).cast("bigint").alias("tracked"),
    )
    paying = F.when(pays, one).otherwise(nothing)
    changes = spans.where(~is_opening()).select(
        "cohort_month",
        F.inline(F.array(
            arrival,
            edge(F.col("from_month"), paying),
            edge(F.add_months("live_to", 1), -paying),
        )),
    ).where("active_accounts != 0 or cohort_size != 0")
    measures = ["active_accounts", "cohort_size", "tracked"]
    return (
        step_series(changes, ["cohort_month"], measures, calendar)
        .where(F.col("tracked") > 0)
        .select(
            "cohort_month",
            month_index_gap(F.col("month_start"), F.col("cohort_month"))
            .alias("months_since_signup"),
            "cohort_size",
            "active_accounts",
            percent(F.col("active_accounts"), F.col("cohort_size"), 1).alias("retention_pct"),
        )
    )


def cohort_heatmap(retention: DataFrame) -> DataFrame:
    """One row per cohort, columns m0, m1, ... up to the last month any cohort reaches; absent
    cells are NULL. A one-row aggregate finds the width: cohorts may start before the calendar."""
    last = retention.agg(F.max("months_since_signup")).first()[0]
    months = range(0 if last is None else last + 1)
    wide = (
        retention.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort"))
        .pivot("months_since_signup", list(months) or [0])
        .agg(F.first("retention_pct"))
    )
    return wide.select("cohort", *[F.col(str(i)).alias(f"m{i}") for i in months])
