"""Versioned refreshes, stored spans and metrics as named SQL."""

import os
from datetime import date

import duckdb
import pytest

from oracle.sql import movement
from revspan import METRICS, Calendar, MetricSuite
from revspan.functions.movement import movement_type
from revspan.plans.named_sql import SQL_METRICS, metric_sql, run_sql
from revspan.sources import span_cache
from revspan.sources.files import children, exists, rename, source_files
from revspan.sources.refresh import Warehouse
from tests.conftest import ACCOUNT, SUBSCRIPTION, make_tables

ACCOUNTS_HEADER = "account_id,account_name,industry,country,signup_date,referral_source,plan_tier,seats,is_trial,churn_flag\n"
SUBSCRIPTIONS_HEADER = "h\n"


def deliver(folder, accounts, subscriptions):
    """CSV files of accounts (id, industry) and subscriptions (id, account, start, end, amount)."""
    folder.mkdir()
    (folder / "accounts.csv").write_text(ACCOUNTS_HEADER + "".join(
        f"{a},Name,{i},US,2023-01-01,ads,Pro,1,False,False\n" for a, i in accounts))
    (folder / "subscriptions.csv").write_text(SUBSCRIPTIONS_HEADER + "".join(
        f"{s},{a},{start},{end},Pro,1,{amount},1,False,False,False,False,monthly,True\n" for s, a, start, end, amount in subscriptions))
    return {name: f"{folder}/{name}.csv" for name in ("accounts", "subscriptions")}


def count_metric(tables):
    return {"by_account": tables["subscriptions"].groupBy("account_id").count()}


# Refreshes

def test_a_failed_refresh_leaves_the_old_version(spark, tmp_path):
    warehouse = Warehouse(spark, f"{tmp_path}/warehouse")
    assert warehouse.manifests() is None and warehouse.versions() == []
    with pytest.raises(LookupError):
        warehouse.open()
    first = deliver(tmp_path / "one", [("a", "X")], [("s1", "a", "2023-01-05", "", "10.00")])
    assert warehouse.refresh(first, count_metric) == 1
    broken = deliver(tmp_path / "two", [("a", "X"), ("b", "Y")], [("s1", "a", "no-day", "", "10.00")])
    with pytest.raises(Exception, match="MALFORMED"):  # accounts are written by then, subscriptions are not
        warehouse.refresh(broken, count_metric)
    assert len(os.listdir(f"{tmp_path}/warehouse/versions")) == 2
    opened = warehouse.open()
    assert warehouse.versions() == [1] and set(opened) == {"accounts", "subscriptions", "by_account"}
    assert [r.account_id for r in opened["accounts"].collect()] == ["a"]


def test_a_failing_metric_and_a_cut_off_manifest_show_nothing(spark, tmp_path):
    warehouse = Warehouse(spark, f"{tmp_path}/warehouse")
    sources = deliver(tmp_path / "one", [("a", "X")], [("s1", "a", "2023-01-05", "", "10.00")])
    with pytest.raises(ZeroDivisionError):
        warehouse.refresh(sources, lambda tables: 1 / 0)
    os.makedirs(f"{tmp_path}/warehouse/manifests/abc/_temporary/0")
    assert warehouse.versions() == []


def test_versions_open_whole_and_expire(spark, tmp_path):
    warehouse = Warehouse(spark, f"{tmp_path}/warehouse")
    for n in (1, 2, 3):
        sources = deliver(tmp_path / f"in{n}", [("a", "X")] * n, [("s", "a", "2023-01-05", "", "1.00")] * 2 * n)
        assert warehouse.refresh(sources, count_metric) == n
    assert [warehouse.open(n)["accounts"].count() for n in (1, 2, 3)] == [1, 2, 3]
    assert warehouse.open(2)["by_account"].first()["count"] == 4
    assert warehouse.open()["subscriptions"].count() == 6
    assert [e.n_rows for e in warehouse.manifests().where("version = 3").first().entries] == [3, 6, 1]
    assert warehouse.expire(keep=2) == [1] and warehouse.versions() == [2, 3]
    with pytest.raises(LookupError):
        warehouse.open(1)
    assert len(os.listdir(f"{tmp_path}/warehouse/versions")) == 2
    with pytest.raises(ValueError):
        warehouse.expire(0)


# Stored spans

def filed(spark, folder, amount):
    tables = make_tables(
        spark, [("a", "X", "Pro", True)], [("1", "a", "01-10", "03-20", amount), ("2", "a", "05-01", None, 5)])
    tables.accounts.write.mode("overwrite").parquet(f"{folder}/accounts")
    tables.subscriptions.coalesce(1).write.mode("overwrite").parquet(f"{folder}/subscriptions")


def suite_on(spark, folder, last="2023-06-01"):
    return MetricSuite(type(make_tables(spark, [], []))(
        spark.read.schema(ACCOUNT).parquet(f"{folder}/accounts"),
        spark.read.schema(SUBSCRIPTION).parquet(f"{folder}/subscriptions")), Calendar.between("2023-01-01", last))


def test_a_second_call_reads_and_a_changed_source_recomputes(spark, tmp_path, monkeypatch):
    filed(spark, tmp_path, 100)
    made = []
    real = span_cache.account_spans
    monkeypatch.setattr(span_cache, "account_spans", lambda *a: made.append(1) or real(*a))
    cache = f"{tmp_path}/cache"
    ending = lambda s: [float(r.ending_mrr) for r in s.waterfall.orderBy("month_start").collect()]
    plain = ending(suite_on(spark, tmp_path))
    assert ending(suite_on(spark, tmp_path).with_cached_spans(cache)) == plain and len(made) == 1
    again = suite_on(spark, tmp_path).with_cached_spans(cache)
    assert ending(again) == plain and len(made) == 1
    assert "WindowExec" not in again.spans._jdf.queryExecution().executedPlan().toString()
    assert again.with_cached_spans(cache) is again
    suite_on(spark, tmp_path, last="2023-05-01").with_cached_spans(cache)  # another calendar
    assert len(made) == 2
    filed(spark, tmp_path, 250)  # new files of other size or time
    assert ending(suite_on(spark, tmp_path).with_cached_spans(cache))[0] == 250.0 and len(made) == 3


def test_old_spans_go_and_tables_without_files_have_none(spark, tmp_path):
    filed(spark, tmp_path, 100)
    s, cache = suite_on(spark, tmp_path), f"{tmp_path}/cache"
    t = s.tables
    for month in ("2023-02-01", "2023-03-01", "2023-04-01"):
        span_cache.cached_spans(t.accounts, t.subscriptions, Calendar.between("2023-01-01", month), "industry", cache, keep=2)
    assert len(children(spark, cache)) == 2
    memory = make_tables(spark, [("a", "X", "Pro", True)], [("1", "a", "01-10", None, 1)])
    with pytest.raises(ValueError):
        span_cache.cached_spans(memory.accounts, memory.subscriptions, s.calendar, "industry", cache)


def test_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/a b/t")
    table = spark.read.parquet(f"{tmp_path}/a b/t")
    (only,) = source_files([table, table])
    assert only.size > 0 and only.modified > 0
    assert exists(spark, f"{tmp_path}/a b") and not exists(spark, f"{tmp_path}/none") and children(spark, f"{tmp_path}/none") == []
    assert not rename(spark, f"{tmp_path}/a b/t", f"{tmp_path}/a b") and rename(spark, f"{tmp_path}/a b/t", f"{tmp_path}/t")


# Named SQL

@pytest.fixture(scope="module")
def suite(spark):
    tables = make_tables(
        spark,
        [("a", "X", "Pro", True), ("b", "Y", "Basic", False), ("c", "X", "Pro", None), ("d", None, None, False)],
        [("1", "a", "01-10", "03-20", 100), ("2", "b", "02-01", None, 50.05, "Basic"), ("3", "a", "05-05", None, 33.33),
         ("4", "c", "03-03", None, 0), ("5", "c", "04-04", None, 7.77), ("6", "b", "06-01", None, 20.20, "Basic")])
    return MetricSuite(tables, Calendar.between("2023-01-01", "2023-07-01")).with_stored_spans()


@pytest.mark.parametrize("name", METRICS)
def test_sql_equals_the_operators(suite, name):
    assert set(METRICS) == set(SQL_METRICS)
    by_sql, by_operator = suite.run_sql(name), suite.run(name)
    assert by_sql.columns == by_operator.columns
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_operator.collect()))


def test_parameters_bound_the_months(spark, suite):
    suite.create_views()
    asked = run_sql(spark, "mrr_waterfall", date(2023, 2, 1), date(2023, 3, 1))
    assert sorted(str(r.month_start) for r in asked.collect()) == ["2023-02-01", "2023-03-01"]
    with pytest.raises(KeyError):
        run_sql(spark, "no_such_metric")
    with pytest.raises(KeyError):
        metric_sql("../secrets")


# The movement rule, on both sides, with negative amounts

AMOUNTS = [-7, -5, 0, 3, 5]
EXPECTED = {(0, -5): "contraction", (-5, 0): "expansion", (0, 5): "new", (5, 0): "churned", (-5, 5): "expansion",
            (5, -5): "contraction", (-7, -5): "expansion", (-5, -7): "contraction", (0, 0): "unchanged", (-5, -5): "unchanged"}


def test_movements_of_negative_amounts(spark):
    pairs = [(p, c) for p in AMOUNTS for c in AMOUNTS]
    df = spark.createDataFrame(
        pairs, "prior int, current int")
    ours = {(r.prior, r.current): r.kind for r in df.withColumn("kind", movement_type(df.prior, df.current)).collect()}
    values = ", ".join(f"({p}, {c})" for p, c in pairs)
    theirs = {(p, c): kind for p, c, kind in duckdb.sql(
        f"SELECT p, c, {movement('p', 'c')} FROM (VALUES {values}) AS t(p, c)").fetchall()}
    assert ours == theirs
    assert {pair: ours[pair] for pair in EXPECTED} == EXPECTED
