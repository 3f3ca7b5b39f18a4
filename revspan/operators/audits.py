"""Data-quality audits. Each returns a small summary frame rather than a pass or fail.

Keys are combined on the map side before they are shuffled, so a key that holds a large
share of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.functions.calendar import Calendar, last_month_covered, month_index_gap, month_of


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def duplicate_keys(table: DataFrame, key: str, label: str) -> DataFrame:
    """How many rows reuse a value that should be a natural key."""
    per_key = table.groupBy(key).agg(F.count("*").alias("n"))
    reused = (F.col("n") > 1).cast("bigint")
    return per_key.select("n", reused.alias("reused"), (F.col("n") - 1).alias("extra")).agg(
        _total("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        _total("reused").alias("n_reused_keys"),
        _total("extra").alias("n_rows_reusing_a_key"),
    ).select(F.lit(label).alias("table_name"), F.lit(key).alias("key_column"), "*")


def reused_key_rows(table: DataFrame, key: str) -> DataFrame:
    """The reused values themselves, with their row counts."""
    return table.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def overlap_rate(timeline: DataFrame) -> DataFrame:
    """Of the subscriptions with an end date and a successor, how many outlive its start."""
    chained = timeline.where(
        F.col("end_date").isNotNull() & F.col("next_start_date").isNotNull()
    )
    return chained.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("end_date") >= F.col("next_start_date")).alias("n_overlapping"),
    )


def signup_gap(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Days from signup to the first subscription."""
    first = subscriptions.groupBy("account_id").agg(F.min("start_date").alias("first_start"))
    gap = F.datediff("first_start", "signup_date")
    return accounts.join(first, "account_id").agg(
        F.count("*").alias("n_accounts"),
        F.count_if(gap > 0).alias("n_with_gap"),
        F.round(F.avg(gap.cast("decimal(18,2)")), 1).alias("avg_gap_days"),
        F.max(gap).alias("max_gap_days"),
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, label: str) -> DataFrame:
    """Rows and distinct keys of ``child`` without a match in ``parent`` (NULL keys pass)."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.count("*").alias("n")
    )
    missing = keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return missing.agg(
        _total("n").alias("n_orphan_rows"), F.count("*").alias("n_orphan_keys")
    ).select(F.lit(label).alias("reference"), "*")


def constraint_profile(
    table: DataFrame, primary_key: str, not_null: Sequence[str], label: str
) -> DataFrame:
    """Primary-key duplicates and NULLs in declared NOT NULL columns, in one pass.

    table_name, column_name, n_rows, n_nulls, n_duplicates (NULL except for the key).
    """
    required = [c for c in not_null if c != primary_key]
    # The key's groups already separate its NULLs, so one grouping answers both questions.
    per_key = table.groupBy(primary_key).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    )
    key_is_null = F.col(primary_key).isNull()
    totals = per_key.agg(
        _total("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(key_is_null, F.col("n"))), F.lit(0)).cast("bigint").alias("key_nulls"),
        F.coalesce(F.sum(F.when(~key_is_null, F.col("n") - 1)), F.lit(0)).cast("bigint")
        .alias("key_duplicates"),
        *[_total(f"null_{c}").alias(f"null_{c}") for c in required],
    )
    lines = [F.struct(
        F.lit(primary_key).alias("column_name"), F.col("key_nulls").alias("n_nulls"),
        F.col("key_duplicates").alias("n_duplicates"),
    )] + [F.struct(
        F.lit(c).alias("column_name"), F.col(f"null_{c}").alias("n_nulls"),
        F.lit(None).cast("bigint").alias("n_duplicates"),
    ) for c in required]
    return totals.select(F.lit(label).alias("table_name"), "n_rows", F.inline(F.array(*lines)))


def coverage_profile(table: DataFrame, day: str, label: str) -> DataFrame:
    """Row count and first and last day of a table."""
    return table.agg(
        F.count("*").alias("n_rows"),
        F.min(F.col(day).cast("date")).alias("first_day"),
        F.max(F.col(day).cast("date")).alias("last_day"),
    ).select(F.lit(label).alias("table_name"), "*")


def broken_identity() -> Column:
    """Whether a month's starting revenue plus its movements is not its ending revenue."""
    expected = (
        F.col("starting_mrr") + F.col("new_mrr") + F.col("expansion_mrr")
        + F.col("contraction_mrr") + F.col("churned_mrr")
    )
    return expected != F.col("ending_mrr")


def identity_breaks(waterfall: DataFrame) -> DataFrame:
    """Months in which starting plus movements is not ending."""
    return waterfall.agg(
        F.count("*").alias("n_months"), F.count_if(broken_identity()).alias("n_breaks"))


def continuity_breaks(waterfall: DataFrame) -> DataFrame:
    """Months that do not start with what the month before ended with."""
    following = F.lead("starting_mrr").over(Window.orderBy("month_start"))
    pairs = waterfall.select("ending_mrr", following.alias("next_starting_mrr"))
    return pairs.where(F.col("next_starting_mrr").isNotNull()).agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("ending_mrr") != F.col("next_starting_mrr")).alias("n_breaks"),
    )


def broken_nrr(tolerance: str = "0.01") -> Column:
    """Whether NRR and net churn do not add up to 100. Both are rounded to two places, so an exact tie
    may leave one hundredth."""
    off = F.abs(F.col("nrr_pct") + F.col("net_mrr_churn_rate_pct") - 100)
    return off > F.lit(tolerance).cast("decimal(5,2)")


def nrr_breaks(rates: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Measurable months where NRR and net churn do not add up to 100."""
    return rates.where(F.col("nrr_pct").isNotNull()).agg(
        F.count("*").alias("n_months"), F.count_if(broken_nrr(tolerance)).alias("n_breaks"))


def panel_uniqueness(timeline: DataFrame, calendar: Calendar) -> DataFrame:
    """Most subscriptions of one account that are active at the same month end.

    Counted from the cleaned intervals themselves: a start counts from its own month, an
    end through the last month it covers whole. A sweep over each account's months: an interval adds one
    where it begins and takes one where it is over, and the running count holds until the next change.
    Changes are summed per account and month before they are shuffled and ordered, so an account of
    any size is one row per calendar month at most, and no interval is laid out over its months.
    """
    last = F.least(last_month_covered(F.col("effective_end_date")), calendar.last)
    changes = (
        timeline
        .select(
            "account_id",
            F.greatest(month_of("start_date"), calendar.first).alias("first_month"),
            last.alias("last_month"),
        )
        .where(F.col("first_month") <= F.col("last_month"))
        .select("account_id", F.inline(F.array(
            F.struct(F.col("first_month").alias("month_start"), F.lit(1).alias("change")),
            F.struct(F.add_months("last_month", 1).alias("month_start"), F.lit(-1).alias("change")),
        )))
        .groupBy("account_id", "month_start").agg(F.sum("change").alias("change"))
    )
    by_month = Window.partitionBy("account_id").orderBy("month_start")
    until = F.lead("month_start").over(by_month)
    steps = changes.select(
        F.sum("change").over(by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
        month_index_gap(until, F.col("month_start")).alias("months"),
    ).where(F.col("n") > 0)
    crowded = F.when(F.col("n") > 1, F.col("months")).otherwise(0)
    return steps.agg(
        F.coalesce(F.sum("months"), F.lit(0)).cast("bigint").alias("n_active_cells"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_matches"),
        F.coalesce(F.sum(crowded), F.lit(0)).cast("bigint").alias("n_violations"),
    )


def panel_completeness(panel: DataFrame, accounts: DataFrame, calendar: Calendar) -> DataFrame:
    """Panel rows against accounts x months."""
    n_accounts = accounts.agg(F.count("*").alias("n")).scalar()
    n_months = calendar.months(panel.sparkSession).agg(F.count("*").alias("n")).scalar()
    return panel.agg(F.count("*").alias("n_rows")).select(
        "n_rows", n_accounts.alias("n_accounts"), n_months.alias("n_months"),
    ).withColumn("is_complete", F.col("n_rows") == F.col("n_accounts") * F.col("n_months"))


def churn_reconciliation(
    accounts: DataFrame, subscriptions: DataFrame, churn_events: DataFrame
) -> DataFrame:
    """How the three records of churn agree: one row per combination, with its accounts.

    The three tables are stacked as (account, which record says churned) and folded per
    account: one shuffle of pre-combined rows instead of two outer joins.
    """
    no, yes = F.lit(False), F.lit(True)

    def says(table: DataFrame, **flags: Column) -> DataFrame:
        return table.select("account_id", *[
            F.coalesce(flags.get(c, no), no).alias(c)
            for c in ("account_flag", "subscription_flag", "event_flag")
        ])

    return (
        stack([
            says(accounts, account_flag=F.col("churn_flag")),
            says(subscriptions, subscription_flag=F.col("churn_flag")),
            says(churn_events, event_flag=yes),
        ])
        .groupBy("account_id")
        .agg(*[F.bool_or(c).alias(c) for c in ("account_flag", "subscription_flag", "event_flag")])
        .groupBy("account_flag", "subscription_flag", "event_flag")
        .agg(F.count("*").alias("n_accounts"))
    )


def segment_tieout(
    segment_monthly: DataFrame, waterfall: DataFrame, dimensions: Sequence[str]
) -> DataFrame:
    """Per dimension: months where the segments' revenue does not sum to the total."""
    nothing = F.lit(0).cast("decimal(2,0)")
    by_segment = segment_monthly.select(
        "dimension", "month_start", F.col("total_mrr").alias("segments"), nothing.alias("whole")
    )
    by_month = waterfall.select(
        F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"),
        "month_start", nothing.alias("segments"), F.col("ending_mrr").alias("whole"),
    )
    return (
        stack([by_segment, by_month])
        .groupBy("dimension", "month_start")
        .agg(F.sum("segments").alias("segments"), F.sum("whole").alias("whole"))
        .groupBy("dimension")
        .agg(
            F.count("*").alias("n_months"),
            F.count_if(F.col("segments") != F.col("whole")).alias("n_breaks"),
        )
    )
