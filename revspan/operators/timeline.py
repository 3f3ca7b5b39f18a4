"""Interval de-overlap: a later start ends every earlier subscription of the account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def subscription_timeline(subscriptions: DataFrame) -> DataFrame:
    """Add ``next_start_date`` and ``effective_end_date`` to every subscription.

    Same-day starts are ordered by subscription_id. Only the distinct start days of an
    account are put in order, each with the last id of its day, so the window holds one row
    per account and day however many rows an account has. The rows themselves meet their
    day in an equi join, which adaptive execution can split where a day is hot.
    """
    days = subscriptions.groupBy("account_id", "start_date").agg(
        F.max("subscription_id").alias("last_id_of_day")
    )
    by_day = Window.partitionBy("account_id").orderBy("start_date")
    days = days.withColumn("next_day", F.lead("start_date").over(by_day))
    next_start = F.when(
        F.col("subscription_id") < F.col("last_id_of_day"), F.col("start_date")
    ).otherwise(F.col("next_day"))
    return (
        subscriptions.join(days, ["account_id", "start_date"], "left")
        .withColumn("next_start_date", next_start)
        .withColumn(
            "effective_end_date",
            F.least("end_date", F.date_sub("next_start_date", 1)),
        )
        .select(*subscriptions.columns, "next_start_date", "effective_end_date")
    )
