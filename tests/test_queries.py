"""Every registered query against DuckDB, its plan, and the known counts of the test tables."""

import os

import pytest

import __spark_entry__ as registered
from benchmarks import dense_forms as dense
from revspan.plans import testbed
from tests.conftest import SF
from tests.oracle_check import connect, duck_rows, spark_rows

QUERIES, ORACLES = registered.core_queries(), registered.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    kinds = {f.dataType.simpleString() for f in df.schema.fields}
    assert kinds <= {"bigint", "double", "string", "date", "boolean", "timestamp_ntz"}
    assert spark_rows(df) == duck_rows(duck, ORACLES[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert node not in plan


def test_entry(spark):
    assert registered.entry(spark).count() == 80


def test_known_counts(spark):
    suite = testbed.suite(spark, SF).with_stored_spans()
    moves = registered.panel.account_movements(suite.spans).groupBy("movement_type").count()
    assert {r.movement_type: r["count"] for r in moves.collect()} == {
        "new": 403, "expansion": 232, "contraction": 223, "churned": 352, "unchanged": 10790}
    assert suite.retention.count() == 1705
    assert (suite.by_tier.count(), suite.by_attribute.count()) == (399, 400)
    december = suite.waterfall.where("month_start = '2000-12-01'").first()
    assert str(december.ending_mrr) == "19651565.34"


def test_busy_accounts_are_thinned_before_the_shuffle_and_columns_pruned(spark):
    plan = testbed.suite(spark, SF).waterfall._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert "o_orderpriority" not in plan  # the tier is not read for the waterfall
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan


def test_rounding_cases_of_the_middle_scale(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no middle scale here")
    suite = testbed.suite(spark, folder).with_stored_spans()
    rates = {str(r.month_start): r for r in suite.rates.collect()}
    assert str(rates["1995-02-01"].gross_mrr_churn_rate_pct) == "5.51"
    assert str(rates["1996-04-01"].nrr_pct) == "95.52"
    cell = suite.by_attribute.where("month_start = '1999-05-01' and industry = 'AUTOMOBILE'").first()
    assert str(cell.avg_mrr_per_account) == "245192.83" and cell.active_accounts == 162


@pytest.mark.parametrize("form", [dense.panel_by_range_join, dense.panel_by_exploded_join])
def test_dense_forms_agree(spark, form):
    suite = testbed.suite(spark, SF)
    tables = (suite.tables.accounts, suite.tables.subscriptions, suite.calendar)
    columns = ["month_start", "account_id", "industry", "mrr", "plan_tier"]
    panel = form(*tables)
    assert spark_rows(panel.select(*columns)) == spark_rows(
        registered.panel.account_month_panel(suite.spans).select(*columns))
    assert spark_rows(dense.waterfall_by_lag(panel)) == spark_rows(suite.waterfall)
    cells = ["cohort_month", "months_since_signup", "cohort_size", "active_accounts", "retention_pct"]
    assert spark_rows(dense.retention_by_panel(panel, tables[1]).select(*cells)) == spark_rows(
        suite.retention.select(*cells))
