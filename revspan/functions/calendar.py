"""Month arithmetic and the calendar spine."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def month_of(day: Column | str) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day, "MM")


def month_index_gap(later: Column, earlier: Column) -> Column:
    """Whole calendar months from ``earlier`` to ``later``."""
    years = F.year(later) - F.year(earlier)
    return years * 12 + F.month(later) - F.month(earlier)


def months_from_to(first: Column, last: Column) -> Column:
    """Array of month starts. Callers filter ``first <= last``: sequence raises otherwise."""
    return F.sequence(first, last, F.expr("interval 1 month"))


def last_month_covered(end_date: Column) -> Column:
    """Last month whose final day is on or before ``end_date`` (NULL stays NULL)."""
    return F.add_months(month_of(F.date_add(end_date, 1)), -1)


@dataclass(frozen=True)
class Calendar:
    """Inclusive range of months; each bound is a DATE column holding a month start.

    The bounds are either literals or uncorrelated scalar subqueries, so a calendar
    taken from the data costs no driver round trip while a plan is being built.
    """

    first: Column
    last: Column
    is_pinned: bool = False

    @staticmethod
    def between(first: date | str, last: date | str) -> Calendar:
        return Calendar(
            month_of(F.lit(str(first)).cast("date")), month_of(F.lit(str(last)).cast("date")),
            is_pinned=True,
        )

    @staticmethod
    def covering(df: DataFrame, day: str) -> Calendar:
        """From the month of the earliest to the month of the latest ``day`` in ``df``."""
        return Calendar(
            df.agg(month_of(F.min(day)).alias("first_month")).scalar(),
            df.agg(month_of(F.max(day)).alias("last_month")).scalar(),
        )

    def resolve(self, spark: SparkSession) -> Calendar:
        """Evaluate the bounds once (a one-row job) and pin them as literals."""
        if self.is_pinned:
            return self
        row = self.bounds(spark).first()
        if row.first_month is None:
            raise ValueError("the calendar has no months: its source has no dates")
        return Calendar.between(row.first_month, row.last_month)

    def bounds(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(
            self.first.alias("first_month"), self.last.alias("last_month")
        )

    def months(self, spark: SparkSession) -> DataFrame:
        """month_start, month_end: one row per calendar month."""
        return (
            self.bounds(spark)
            .select(F.explode(months_from_to(F.col("first_month"), F.col("last_month")))
                    .alias("month_start"))
            .withColumn("month_end", F.last_day("month_start"))
        )

    def n_months(self, spark: SparkSession) -> int:
        row = self.bounds(spark).select(
            month_index_gap(F.col("last_month"), F.col("first_month")).alias("gap")
        ).first()
        return row.gap + 1
