"""The driver's order tables seen as subscription tables.

An order is a subscription that starts on its order date; a finished order ends with its
last shipment; a pending order is a trial at no charge. Customers are the accounts, events
stand in for usage and support tickets. Columns the order tables have nothing for are filled
by small rules on the key, so that every declared column holds data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revspan.functions.calendar import Calendar
from revspan.functions.money import MONEY, no_money
from revspan.plans.suite import MetricSuite
from revspan.sources.schemas import TABLES


# The columns of the driver's tables. Declaring them saves a job per table
# that would read a file footer to find them out.
DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


class Source:
    """The Parquet tables of one folder, each opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._opened: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(
                f"{self.folder}/{name}.parquet"
            )
        return self._opened[name]


def subscriptions(source: Source) -> DataFrame:
    key = F.col("o_orderkey")
    finished, trial = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    last_shipment = source("lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship")
    )
    orders = source("orders")
    ended = orders.join(last_shipment, (key == F.col("l_orderkey")) & finished, "left")
    start, end = F.col("o_orderdate").cast("date"), F.col("last_ship").cast("date")
    amount = F.when(trial, no_money()).otherwise(F.col("o_totalprice").cast(MONEY))
    return ended.select(
        key.alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.col("o_orderpriority").alias("plan_tier"),
        (key % 50 + 1).cast("int").alias("seats"),
        amount.alias("mrr_amount"),
        (amount * 12).cast(MONEY).alias("arr_amount"),
        trial.alias("is_trial"),
        (F.col("o_orderpriority") == "1-URGENT").alias("upgrade_flag"),
        (F.col("o_orderpriority") == "5-LOW").alias("downgrade_flag"),
        F.coalesce(end >= start, F.lit(False)).alias("churn_flag"),
        F.when(key % 3 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        (key % 2 == 0).alias("auto_renew_flag"),
    )


def accounts(source: Source, with_country: bool = False) -> DataFrame:
    """``with_country`` adds the nation's name, which no metric reads."""
    first_order = (
        source("orders")
        .groupBy("o_custkey")
        .agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("first_order"))
    )
    key = F.col("c_custkey")
    rows = source("customer").join(first_order, key == F.col("o_custkey"), "left")
    country: Column = F.lit(None).cast("string")
    if with_country:
        nation = source("nation").select("n_nationkey", "n_name")
        rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        country = F.col("n_name")
    first_day = F.col("first_order.o_orderdate").cast("date")
    return rows.select(
        key.alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("c_mktsegment").alias("industry"),
        country.alias("country"),
        F.date_sub(first_day, (key % 40).cast("int")).alias("signup_date"),
        F.when(key % 3 == 0, "partner").otherwise("organic").alias("referral_source"),
        F.col("first_order.o_orderpriority").alias("plan_tier"),
        (key % 100 + 1).cast("int").alias("seats"),
        (key % 10 == 0).alias("is_trial"),
        (F.col("c_acctbal") < 0).alias("churn_flag"),
    )


def feature_usage(source: Source) -> DataFrame:
    key = F.col("event_id")
    return source("events").select(
        key.alias("usage_id"),
        F.col("user_id").alias("subscription_id"),
        F.col("ts").cast("date").alias("usage_date"),
        F.col("event_type").alias("feature_name"),
        (key % 5 + 1).cast("int").alias("usage_count"),
        F.floor("value").cast("int").alias("usage_duration_secs"),
        (F.col("event_type") == "error").cast("int").alias("error_count"),
        (key % 7 == 0).alias("is_beta_feature"),
    )


def support_tickets(source: Source) -> DataFrame:
    key = F.col("event_id")
    opened = F.date_trunc("second", "ts").cast("timestamp_ntz")
    minutes = F.floor("value").cast("int")
    resolved = key % 4 != 0
    return source("events").select(
        key.alias("ticket_id"),
        F.col("user_id").alias("account_id"),
        opened.alias("submitted_at"),
        F.when(resolved, opened + F.make_dt_interval(mins=minutes)).alias("closed_at"),
        F.when(resolved, F.col("value").cast("decimal(10,2)")).alias("resolution_time_hours"),
        F.col("event_type").alias("priority"),
        minutes.alias("first_response_time_minutes"),
        F.when(key % 6 != 0, key % 6).cast("decimal(2,1)").alias("satisfaction_score"),
        (F.col("event_type") == "error").alias("escalation_flag"),
    )


def churn_events(source: Source) -> DataFrame:
    tier = F.col("plan_tier")
    return subscriptions(source).where(F.col("end_date").isNotNull()).select(
        F.col("subscription_id").alias("churn_event_id"),
        "account_id",
        F.col("end_date").alias("churn_date"),
        tier.alias("reason_code"),
        F.col("mrr_amount").alias("refund_amount_usd"),
        F.col("upgrade_flag").alias("preceding_upgrade_flag"),
        F.col("downgrade_flag").alias("preceding_downgrade_flag"),
        F.lit(False).alias("is_reactivation"),
        F.concat(F.lit('left "'), tier, F.lit('",\nwith regret')).alias("feedback_text"),
    )


class MappedTables:
    """The five tables, each mapped when first asked for."""

    def __init__(self, source: Source):
        self.source = source

    @cached_property
    def accounts(self) -> DataFrame:
        return accounts(self.source)

    @cached_property
    def subscriptions(self) -> DataFrame:
        return subscriptions(self.source)

    @cached_property
    def feature_usage(self) -> DataFrame:
        return feature_usage(self.source)

    @cached_property
    def support_tickets(self) -> DataFrame:
        return support_tickets(self.source)

    @cached_property
    def churn_events(self) -> DataFrame:
        return churn_events(self.source)


def calendar(source: Source) -> Calendar:
    """From the month of the first order to that of the last."""
    days = source("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return Calendar.covering(days, "day")


def suite(spark: SparkSession, sf_dir: str, resolved: bool = True) -> MetricSuite:
    """Its calendar is read off the orders once, so that no metric scans them for it again.

    With ``resolved=False`` nothing is read: for results that need no calendar."""
    source = Source(spark, sf_dir)
    months = calendar(source)
    return MetricSuite(MappedTables(source), months.resolve(spark) if resolved else months)


def as_declared(table: DataFrame, name: str) -> DataFrame:
    """The columns of a mapped table in their declared order and types."""
    return table.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema.fields
    ])
