"""Step functions over months: from changes to the value in every month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from revspan.functions.calendar import Calendar, months_from_to


def step_series(
    changes: DataFrame, keys: Sequence[str], measures: Sequence[str], calendar: Calendar
) -> DataFrame:
    """Running totals of ``measures`` per ``keys``, one row per month.

    The series of a key starts at its first change and runs to the end of the calendar.
    The changes are combined per key and month before anything is ordered, so a window
    group never holds more than the calendar's months.
    """
    monthly = (
        changes.where(F.col("month_start") <= calendar.last)
        .groupBy(*keys, "month_start")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    by_month = Window.partitionBy(*keys).orderBy("month_start")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.add_months(F.lead("month_start").over(by_month), -1), calendar.last)
    return (
        monthly
        .select(
            *keys,
            F.col("month_start").alias("step_from"),
            until.alias("step_until"),
            *[F.sum(m).over(so_far).alias(m) for m in measures],
        )
        .select(
            *keys,
            F.explode(months_from_to(F.col("step_from"), F.col("step_until"))).alias("month_start"),
            *measures,
        )
    )
