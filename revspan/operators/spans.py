"""Spans: the month-end view of every account as a few intervals of whole months.

At a month end an account shows its last-started subscription, if that one has not ended.
So only the last start of each account and month can ever show, and it stays in charge until
the month of the account's next start. One row per such reign replaces the account x month
grid; all revenue metrics are sums over the edges of these rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.functions.calendar import Calendar, last_month_covered, month_of
from revspan.functions.money import no_money


def _last_start_per_month(subscriptions: DataFrame, calendar: Calendar) -> DataFrame:
    """Last-started subscription of each account and month.

    Spark keeps the first row of each group already on the map side, so a busy account
    leaves every task with at most one row per month of its history.
    """
    latest_first = Window.partitionBy("account_id", "start_month").orderBy(
        F.col("start_date").desc(), F.col("subscription_id").desc()
    )
    return (
        subscriptions
        .where(F.col("start_date") <= F.last_day(calendar.last))
        .withColumn("start_month", month_of("start_date"))
        .withColumn("recency", F.row_number().over(latest_first))
        .where(F.col("recency") == 1)
        .select(
            "account_id", "start_month",
            last_month_covered(F.col("end_date")).alias("last_full_month"),
            F.coalesce("mrr_amount", no_money()).alias("mrr"),
            "plan_tier",
            F.lit(False).alias("opening"),
        )
    )


def account_spans(
    accounts: DataFrame,
    subscriptions: DataFrame,
    calendar: Calendar,
    attributes: Sequence[str] = ("industry",),
) -> DataFrame:
    """One row per account and reign, in one window over the account.

    Every known account also gets an opening row, which carries its ``attributes`` and
    covers the calendar up to its first start.

    account_id, from_month, to_month: the calendar months the row is in charge of; a reign
        that another one replaced before the calendar begins has none (from > to)
    live_to: last month in which the subscription is active (before from_month: none)
    mrr, plan_tier: of that subscription
    entry_prior: the account's revenue in the calendar month before from_month
    cohort_month: month of the account's first start (NULL on the opening row)
    is_first, is_known: first reign of the account; account exists in ``accounts``
    paid_before: the account had revenue in some calendar month before from_month
    """
    openings = accounts.select(
        "account_id",
        calendar.first.alias("start_month"),
        F.lit(True).alias("opening"),
        *attributes,
    )
    rows = _last_start_per_month(subscriptions, calendar).unionByName(
        openings, allowMissingColumns=True
    )

    w = Window.partitionBy("account_id").orderBy(F.col("opening").desc(), "start_month")
    own_month = F.when(~F.col("opening"), F.col("start_month"))
    before = F.add_months("from_month", -1)
    reaches_here = F.col("prev_last_full_month").isNull() | (F.col("prev_last_full_month") >= before)
    has_prior = F.col("prev_mrr").isNotNull() & reaches_here & (F.col("start_month") > calendar.first)
    alive_until = F.least("to_month", "last_full_month")
    pays = ~F.col("opening") & (F.col("mrr") > 0) & (alive_until >= F.col("from_month"))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows
        .select(
            "*",
            F.lead("start_month").over(w).alias("next_start_month"),
            F.lag("last_full_month").over(w).alias("prev_last_full_month"),
            F.lag("mrr").over(w).alias("prev_mrr"),
            F.lag("opening").over(w).alias("prev_opening"),
            F.first("opening").over(w).alias("is_known"),
            F.first(own_month, ignorenulls=True).over(w).alias("cohort_month"),
            *[F.first(a).over(w).alias(f"account_{a}") for a in attributes],
        )
        .withColumns({
            "from_month": F.greatest(F.col("start_month"), calendar.first),
            "to_month": F.coalesce(F.add_months("next_start_month", -1), calendar.last),
        })
        .select(
            "account_id", "from_month", "to_month",
            F.when(F.col("opening"), before).otherwise(alive_until).alias("live_to"),
            F.coalesce("mrr", no_money()).alias("mrr"),
            "plan_tier",
            F.when(has_prior, F.col("prev_mrr")).otherwise(no_money()).alias("entry_prior"),
            "cohort_month",
            (~F.col("opening") & F.coalesce("prev_opening", F.lit(True))).alias("is_first"),
            "is_known",
            F.coalesce(F.bool_or(pays).over(earlier), F.lit(False)).alias("paid_before"),
            *[F.col(f"account_{a}").alias(a) for a in attributes],
        )
    )


def is_live() -> Column:
    """The reign has at least one active month."""
    return F.col("live_to") >= F.col("from_month")


def is_opening() -> Column:
    """The row that stands for the months before an account's first start."""
    return F.col("cohort_month").isNull()


def span_edges(
    spans: DataFrame, keep: Sequence[str], measures: dict[str, Column], with_openings: bool = False
) -> DataFrame:
    """Each live reign as two rows: its measures at the first month, and minus the same
    in the month after the last active one.

    ``with_openings`` keeps the accounts' opening rows too. Their revenue is 0, so they mark
    that the account's segment exists from the first calendar month.
    """
    def edge(month: Column, sign: int) -> Column:
        return F.struct(
            month.alias("month_start"),
            *[(m if sign > 0 else -m).alias(name) for name, m in measures.items()],
        )

    wanted = is_live() | is_opening() if with_openings else is_live()
    edges = F.array(edge(F.col("from_month"), 1), edge(F.add_months("live_to", 1), -1))
    return spans.where(F.col("is_known") & wanted).select(*keep, F.inline(edges))
