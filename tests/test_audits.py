"""Audits must find planted defects."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from revspan import Calendar, MetricSuite
from revspan.operators import audits
from revspan.operators.panel import account_month_panel
from revspan.operators.timeline import subscription_timeline
from tests.conftest import make_tables

CALENDAR = ("2023-01-01", "2023-06-01")


@pytest.fixture(scope="module")
def tables(spark):
    return make_tables(
        spark,
        [("a", "X", "Pro", True), ("b", "X", "Pro", False), ("c", "Y", "Pro", None)],
        [
            ("1", "a", "01-10", "03-20", 100),   # outlives its successor
            ("2", "a", "03-01", "03-31", 100),   # ends before its successor
            ("3", "a", "05-01", None, 100),
            ("4", "b", "02-01", None, 50),
            ("5", "nobody", "02-01", None, 50),
        ],
    )


def test_duplicate_keys(spark):
    usage = spark.createDataFrame([("u1",), ("u1",), ("u1",), ("u2",)], "usage_id string")
    r = audits.duplicate_keys(usage, "usage_id", "usage").first()
    assert (r.n_rows, r.n_keys, r.n_reused_keys, r.n_rows_reusing_a_key) == (4, 2, 1, 2)
    assert [tuple(x) for x in audits.reused_key_rows(usage, "usage_id").collect()] == [("u1", 3)]
    empty = audits.duplicate_keys(usage.limit(0), "usage_id", "usage").first()
    assert (empty.n_rows, empty.n_keys, empty.n_reused_keys) == (0, 0, 0)


def test_overlap_rate(tables):
    r = audits.overlap_rate(subscription_timeline(tables.subscriptions)).first()
    assert (r.n_pairs, r.n_overlapping) == (2, 1)


def test_signup_gap(tables):
    r = audits.signup_gap(tables.accounts, tables.subscriptions).first()
    assert (r.n_accounts, r.n_with_gap, float(r.avg_gap_days), r.max_gap_days) == (2, 2, 20.0, 31)


def test_orphans(tables):
    r = audits.orphans(tables.subscriptions, "account_id", tables.accounts, "account_id", "fk").first()
    assert (r.reference, r.n_orphan_rows, r.n_orphan_keys) == ("fk", 1, 1)
    r = audits.orphans(tables.accounts, "account_id", tables.accounts, "account_id", "fk").first()
    assert (r.n_orphan_rows, r.n_orphan_keys) == (0, 0)


def test_constraint_profile(spark):
    df = spark.createDataFrame(
        [("1", "x"), ("1", None), (None, "y"), (None, None)], "id string, name string")
    rows = {r.column_name: r for r in audits.constraint_profile(df, "id", ["name"], "t").collect()}
    assert (rows["id"].n_rows, rows["id"].n_nulls, rows["id"].n_duplicates) == (4, 2, 1)
    assert (rows["name"].n_nulls, rows["name"].n_duplicates) == (2, None)


def test_coverage(tables):
    r = audits.coverage_profile(tables.subscriptions, "start_date", "subscriptions").first()
    assert (r.n_rows, r.first_day, r.last_day) == (5, date(2023, 1, 10), date(2023, 5, 1))


def test_panel_uniqueness_sees_overlaps(tables):
    calendar = Calendar.between(*CALENDAR)
    clean = audits.panel_uniqueness(subscription_timeline(tables.subscriptions), calendar).first()
    assert (clean.max_matches, clean.n_violations) == (1, 0)
    raw = tables.subscriptions.withColumn("effective_end_date", F.lit(None).cast("date"))
    dirty = audits.panel_uniqueness(raw, calendar).first()
    assert dirty.max_matches == 3 and dirty.n_violations == 4


def test_panel_completeness(tables):
    suite = MetricSuite(tables, Calendar.between(*CALENDAR))
    panel = account_month_panel(suite.spans)
    r = audits.panel_completeness(panel, tables.accounts, suite.calendar).first()
    assert (r.n_rows, r.n_accounts, r.n_months, r.is_complete) == (18, 3, 6, True)
    r = audits.panel_completeness(panel.where("account_id != 'c'"), tables.accounts, suite.calendar).first()
    assert r.is_complete is False


def test_churn_reconciliation(spark, tables):
    events = spark.createDataFrame([("b",), ("b",)], "account_id string")
    rows = {(r.account_flag, r.subscription_flag, r.event_flag): r.n_accounts
            for r in audits.churn_reconciliation(tables.accounts, tables.subscriptions, events).collect()}
    assert rows == {(True, False, False): 1, (False, False, True): 1, (False, False, False): 2}


def test_segment_tieout(tables):
    suite = MetricSuite(tables, Calendar.between(*CALENDAR)).with_stored_spans()
    dimensions = ("plan_tier", "industry")
    rows = audits.segment_tieout(suite.segment_monthly, suite.waterfall, dimensions).collect()
    assert {(r.dimension, r.n_months, r.n_breaks) for r in rows} == {
        ("plan_tier", 6, 0), ("industry", 6, 0)}
    off = suite.segment_monthly.where("dimension = 'industry' or month_start != '2023-02-01'")
    rows = {r.dimension: r.n_breaks
            for r in audits.segment_tieout(off, suite.waterfall, dimensions).collect()}
    assert rows == {"plan_tier": 1, "industry": 0}
