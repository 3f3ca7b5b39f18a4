"""Monthly revenue waterfall and the churn and retention rates on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.functions.calendar import Calendar
from revspan.functions.money import no_money, percent
from revspan.functions.movement import CHURNED, CONTRACTION, EXPANSION, NEW, movement_type
from revspan.operators.spans import is_live

FLOWS = {
    "new_mrr": NEW,
    "expansion_mrr": EXPANSION,
    "contraction_mrr": CONTRACTION,
    "churned_mrr": CHURNED,
}


def _flow_sums(kind: Column, delta: Column) -> list[Column]:
    return [
        F.sum(F.when(kind == k, delta).otherwise(no_money())).alias(name)
        for name, k in FLOWS.items()
    ]


def waterfall_from_movements(movements: DataFrame) -> DataFrame:
    """The waterfall of a stored dense movement table."""
    return movements.groupBy("month_start").agg(
        F.sum("prior_mrr").alias("starting_mrr"),
        *_flow_sums(F.col("movement_type"), F.col("mrr_delta")),
        F.sum("current_mrr").alias("ending_mrr"),
    )


def mrr_waterfall(spans: DataFrame, calendar: Calendar) -> DataFrame:
    """The waterfall from the edges of the spans alone.

    Revenue moves only where a reign begins and where it falls silent, so nothing is summed
    over unchanged months; the balances are running totals of the flows. Only the monthly
    totals, one row per calendar month, are put in order.
    """
    def edge(month: Column, prior: Column, current: Column) -> Column:
        return F.struct(
            month.alias("month_start"), prior.alias("prior_mrr"), current.alias("current_mrr")
        )

    at_entry = F.when(is_live(), F.col("mrr")).otherwise(no_money())
    falls_silent = is_live() & (F.col("live_to") < F.col("to_month"))
    edges = F.array(
        edge(F.col("from_month"), F.col("entry_prior"), at_entry),
        edge(
            F.add_months("live_to", 1),
            F.when(falls_silent, F.col("mrr")).otherwise(no_money()),
            no_money(),
        ),
    )
    prior, current = F.col("prior_mrr"), F.col("current_mrr")
    moves = (
        spans.where("is_known").select(F.inline(edges))
        .where(prior != current)
        .select(
            "month_start",
            (current - prior).alias("delta"),
            movement_type(prior, current).alias("kind"),
        )
    )
    months = calendar.months(spans.sparkSession).select(
        "month_start", no_money().alias("delta"), F.lit(None).cast("string").alias("kind")
    )
    flows = moves.unionByName(months).groupBy("month_start").agg(
        F.sum("delta").alias("net_change"), *_flow_sums(F.col("kind"), F.col("delta"))
    )
    so_far = Window.orderBy("month_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        flows.withColumn("ending_mrr", F.sum("net_change").over(so_far))
        .select(
            "month_start",
            (F.col("ending_mrr") - F.col("net_change")).alias("starting_mrr"),
            *FLOWS,
            "ending_mrr",
        )
    )


def new_mrr_split(spans: DataFrame, calendar: Calendar) -> DataFrame:
    """New revenue of every month, split into that of accounts that never paid before and of returning ones.

    month_start, new_mrr, first_mrr, returning_mrr, n_first, n_returning. Revenue out of nothing begins only
    where a reign does, and whether the account has paid in an earlier calendar month is part of its span.
    """
    begins = spans.where(F.col("is_known") & is_live() & (movement_type(F.col("entry_prior"), F.col("mrr")) == NEW))
    entries = begins.select(F.col("from_month").alias("month_start"), "mrr", "paid_before")
    months = calendar.months(spans.sparkSession).select(
        "month_start", no_money().alias("mrr"), F.lit(None).cast("boolean").alias("paid_before"))
    returning = F.col("paid_before")
    return entries.unionByName(months).groupBy("month_start").agg(
        F.sum("mrr").alias("new_mrr"),
        F.sum(F.when(~returning, F.col("mrr")).otherwise(no_money())).alias("first_mrr"),
        F.sum(F.when(returning, F.col("mrr")).otherwise(no_money())).alias("returning_mrr"),
        F.count_if(~returning).alias("n_first"),
        F.count_if(returning).alias("n_returning"),
    )


def with_rates(waterfall: DataFrame) -> DataFrame:
    """Add gross churn, net churn and net revenue retention; NULL where starting_mrr is 0.

    Net retention is computed from its own terms, not as 100 minus net churn, so that the
    two can be checked against each other.
    """
    starting = F.col("starting_mrr")
    lost = F.col("contraction_mrr") + F.col("churned_mrr")
    gained = F.col("expansion_mrr")
    return waterfall.select(
        "*",
        percent(-lost, starting, 2).alias("gross_mrr_churn_rate_pct"),
        percent(-(lost + gained), starting, 2).alias("net_mrr_churn_rate_pct"),
        percent(starting + gained + lost, starting, 2).alias("nrr_pct"),
    )


def revenue_rates(waterfall: DataFrame) -> DataFrame:
    """The rates with the totals they come from."""
    return with_rates(waterfall).drop("new_mrr", "ending_mrr")


def measurable_months(rates: DataFrame) -> DataFrame:
    """Months that had revenue to lose."""
    return rates.dropna(subset=["gross_mrr_churn_rate_pct"])
