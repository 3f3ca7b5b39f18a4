import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("revspan-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SUBSCRIPTION = (
    "subscription_id string, account_id string, start_date date, end_date date, "
    "plan_tier string, mrr_amount decimal(12,2), churn_flag boolean"
)
ACCOUNT = "account_id string, industry string, plan_tier string, churn_flag boolean, signup_date date"


def day(text):
    """'2023-03-05', or '03-05' in 2023; None stays None."""
    if text is None:
        return None
    return date.fromisoformat(text if len(text) > 5 else f"2023-{text}")


def make_tables(spark, accounts, subscriptions):
    """accounts: (id, industry, tier, churned); subscriptions: (id, account, start, end, amount[, tier])."""
    from decimal import Decimal

    from revspan import Tables

    subs = [
        (s[0], s[1], day(s[2]), day(s[3]), s[5] if len(s) > 5 else "Pro",
         None if s[4] is None else Decimal(str(s[4])), False)
        for s in subscriptions
    ]
    accts = [(a[0], a[1], a[2], a[3], date(2023, 1, 1)) for a in accounts]
    return Tables(
        spark.createDataFrame(accts, ACCOUNT), spark.createDataFrame(subs, SUBSCRIPTION)
    )
