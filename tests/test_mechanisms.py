"""Sweep line, dense keys, audits in one pass, the month store, returning accounts and monthly documents."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from revspan import Calendar, MetricSuite
from revspan.operators import audits, explore, panel, segments, snapshot, waterfall
from revspan.plans.audited import store_with_audits
from revspan.sources import tables as io
from revspan.sources.schemas import TABLES
from revspan.sources.shared import stored
from tests.conftest import make_tables


@pytest.fixture(scope="module")
def calendar(spark):
    return Calendar.between("2023-01-01", "2023-12-01")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# H10: the sweep

def random_intervals(rng, n):
    out = []
    for i in range(n):
        start = date(2022, 11, 1) + timedelta(days=rng.randrange(420))
        end = None if rng.random() < 0.3 else start + timedelta(days=rng.randrange(-5, 200))
        out.append((rng.choice("aaaaabcd"), start, end))
    return out


def month_ends():
    return [date(2023 + m // 12, m % 12 + 1, 1) - timedelta(days=1) for m in range(1, 13)]


def test_sweep_counts_what_is_active_at_month_ends(calendar, spark):
    for seed in range(5):
        rows = random_intervals(random.Random(seed), 60)
        timeline = spark.createDataFrame(rows, "account_id string, start_date date, effective_end_date date")
        cells = {}
        for account, start, end in rows:
            for day in month_ends():
                if start <= day and (end is None or end >= day):
                    cells[account, day] = cells.get((account, day), 0) + 1
        got = audits.panel_uniqueness(timeline, calendar).first()
        assert tuple(got) == (len(cells), max(cells.values()), sum(n > 1 for n in cells.values()))
    empty = audits.panel_uniqueness(timeline.limit(0), calendar)
    assert tuple(empty.first()) == (0, 0, 0)


def test_sweep_lays_no_interval_out_over_its_months(calendar, spark):
    # One account holds most rows: after the map-side sums it is at most one row a month.
    rows = [("busy", date(2023, 1, 1) + timedelta(days=i % 300), None) for i in range(5_000)] + [("b", date(2023, 2, 2), None)]
    timeline = spark.createDataFrame(rows, "account_id string, start_date date, effective_end_date date")
    df = audits.panel_uniqueness(timeline, calendar)
    assert df.first().max_matches == 5_000
    assert "sequence(" not in plan_of(df) and plan_of(df).count("partial_sum(change") >= 1


# A5: dense keys

USAGE = "usage_id string, subscription_id string, usage_date date, feature_name string"


def test_dense_keys_have_no_gaps_and_stay(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(40)}", rng.choice(["s1", "s2", None]), date(2023, 1, 1 + rng.randrange(28)), rng.choice("xy"))
            for _ in range(500)]
    order = ("usage_date", "subscription_id", "usage_id")
    expected = sorted(rows, key=lambda r: (r[2], r[1] is not None, r[1] or "", r[0], r[3]))
    for parts, shuffled in ((4, rows), (7, rng.sample(rows, len(rows)))):
        table = spark.createDataFrame(shuffled, USAGE).repartition(parts)
        keyed = io.with_dense_key(table, "usage_pk", order)
        assert keyed.columns[0] == "usage_pk" and "Window" not in plan_of(keyed)
        got = sorted(tuple(r) for r in keyed.collect())
        assert [r[0] for r in got] == list(range(1, 501)) and [r[1:] for r in got] == expected
    assert io.with_dense_key(table.limit(0), "usage_pk", order).count() == 0


def test_dense_keys_of_a_load_are_the_same_on_a_second_one(spark, tmp_path):
    (tmp_path / "u.csv").write_text("h\n" + "".join(f"u{i % 9},s{i % 3},2023-01-0{i % 5 + 1},f,1,2,0,False\n" for i in range(60)))
    first, second = (
        sorted(tuple(r) for r in io.load_table(spark, f"{tmp_path}/u.csv", TABLES["feature_usage"], f"{tmp_path}/t{n}").collect())
        for n in (1, 2))
    assert first == second and [r[0] for r in first] == list(range(1, 61))


# A7: free text

def test_free_text_files_that_are_too_big_are_refused(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"c{n}.csv").write_text("h\n" + "e1,a1,2023-03-01,price,10.00,True,False,False,text\n" * (1 + 30 * n))
    spec, path = TABLES["churn_events"], f"{tmp_path}/*.csv"
    with pytest.raises(ValueError, match=r"1 of 2 files .* deliver at least 5 files"):
        io.load_table(spark, path, spec, f"{tmp_path}/t", most_free_text=400)
    assert io.load_table(spark, path, spec, f"{tmp_path}/t").count() == 32


# One pass of audits

@pytest.fixture(scope="module")
def suite(spark, calendar):
    tables = make_tables(
        spark,
        [("a", "X", "Pro", True), ("b", "Y", "Basic", False), ("c", "X", "Pro", None), ("d", None, None, False)],
        [("1", "a", "01-10", "03-20", 100), ("2", "b", "02-01", "04-10", 50, "Basic"), ("3", "a", "05-05", None, 30),
         ("4", "c", "03-03", None, 0), ("5", "c", "04-04", "05-31", 7), ("6", "b", "06-01", None, 20, "Basic"),
         ("7", "c", "09-01", None, 9), ("8", "nobody", "02-02", None, 4)])
    return MetricSuite(tables, calendar)


def test_audits_in_one_pass_equal_the_single_ones(calendar, spark, suite):
    audited, result = store_with_audits(suite)
    got = {(r.audit, r.subject): r for r in result.collect()}
    for name, single in (("identity", audits.identity_breaks(suite.waterfall)), ("nrr", audits.nrr_breaks(suite.rates)),
                         ("continuity", audits.continuity_breaks(suite.waterfall))):
        row = got[name, "mrr_waterfall"]
        assert (row.n_checked, row.n_breaks) == tuple(single.first())
    complete = audits.panel_completeness(panel.account_month_panel(suite.spans), suite.tables.accounts, calendar).first()
    row = got["completeness", "account_month_mrr"]
    assert (row.n_checked, row.n_breaks == 0) == (complete.n_rows, complete.is_complete)
    for name, day in (("accounts", "signup_date"), ("subscriptions", "start_date")):
        single = audits.coverage_profile(getattr(suite.tables, name), day, name).first()
        assert (got["coverage", name].n_checked, got["coverage", name].first_day, got["coverage", name].last_day) == single[1:]
    profile = audits.constraint_profile(suite.tables.subscriptions, "subscription_id", ["account_id", "start_date"], "s").collect()
    for single in profile:
        assert got["not_null", f"subscriptions.{single.column_name}"].n_breaks == single.n_nulls
    assert sorted(map(str, audited.waterfall.collect())) == sorted(map(str, suite.waterfall.collect()))


def test_planted_defects_show_in_the_pass(calendar, spark, suite):
    holed = suite.tables.subscriptions.withColumn("account_id", F.when(F.col("subscription_id") != "1", F.col("account_id")))
    twice = suite.tables.accounts.unionByName(suite.tables.accounts.where("account_id = 'a'"))
    broken = MetricSuite(type(suite.tables)(twice, holed), calendar)
    got = {(r.audit, r.subject): r for r in store_with_audits(broken)[1].collect()}
    assert got["not_null", "subscriptions.account_id"].n_breaks == 1
    assert got["coverage", "accounts"].n_checked == 5


# Month store

def scans(df):
    """(partitions read) of the file scans of a plan that has run."""
    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            yield from walk(node.plan())
            return
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metric = node.metrics().get("numPartitions")
            if metric.isDefined():
                yield metric.get().value()
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_requests_prune_the_month_store(calendar, spark, suite, tmp_path):
    path = f"{tmp_path}/by_month"
    io.write_by_month(suite.segment_monthly, path)
    all_requests = explore.yearly_requests(suite.churn, calendar)
    rows = [(f"r{i}", d, s, date(2023, 5, 1), date(2023, 6, 1)) for i, (d, s) in enumerate(
        [("industry", "X"), ("plan_tier", "Basic"), ("industry", "gone"), ("all", None)])]
    requests = stored(spark.createDataFrame(rows, all_requests.schema), "requests")
    monthly, churn = stored(suite.monthly, "monthly"), stored(suite.churn, "churn")
    df = explore.segment_kpis_from_store(requests, spark.read.parquet(path), churn, monthly, calendar)
    assert "dynamicpruningexpression" in plan_of(df)
    got = sorted(map(str, df.collect()))
    assert scans(df) == [2]  # of twelve months
    plain = explore.segment_range_kpis(requests, suite.segment_monthly, suite.churn, suite.monthly, calendar)
    assert got == sorted(map(str, plain.select(*df.columns).collect())) and len(got) == 3


# Both dimensions in one series

def test_both_dimensions_come_from_one_exchange_series(calendar, spark, suite):
    s = suite.with_stored_spans()
    expected = []
    for dimension, table in (("plan_tier", s.by_tier), ("industry", s.by_attribute)):
        expected += [(dimension, *map(str, r)) for r in table.select(
            dimension, "month_start", "active_accounts", F.col("total_mrr").cast("decimal(22,2)")).collect()]
    got = [(r.dimension, *map(str, r[1:])) for r in s.segment_monthly.select(
        "dimension", "segment", "month_start", "active_accounts", F.col("total_mrr").cast("decimal(22,2)")).collect()]
    assert sorted(got) == sorted(expected)
    assert plan_of(s.segment_monthly).count("FileScan parquet") == 1
    assert segments.monthly_mrr_by_dimension(s.spans, calendar, "plan_tier", "industry").columns == [
        "dimension", "segment", "month_start", "active_accounts", "total_mrr"]


# Returning accounts

def test_new_revenue_is_first_or_returning(calendar, suite):
    split = {str(r.month_start): r for r in waterfall.new_mrr_split(suite.spans, calendar).collect()}
    total = {str(r.month_start): r.new_mrr for r in suite.waterfall.collect()}
    assert len(split) == 12 and {m: r.new_mrr for m, r in split.items()} == total
    assert all(r.first_mrr + r.returning_mrr == r.new_mrr for r in split.values())
    # b paid from February to March and again from June; a from January to February and again from May; c, whose first
    # subscription was free, first paid in April and, falling silent at the end of May, again in September.
    firsts = {m: (r.n_first, r.n_returning) for m, r in split.items() if r.n_first or r.n_returning}
    assert firsts == {"2023-01-01": (1, 0), "2023-02-01": (1, 0), "2023-04-01": (1, 0), "2023-05-01": (0, 1),
                      "2023-06-01": (0, 1), "2023-09-01": (0, 1)}


# Documents

def test_documents_hold_a_month_s_lines_in_order(spark, suite, tmp_path):
    s = suite.with_stored_spans()
    numbered = snapshot.numbered_facts(s.facts, s.report)
    documents = snapshot.summary_documents(numbered, "maker")
    io.write_documents(documents, f"{tmp_path}/documents")
    back = io.read_documents(spark, f"{tmp_path}/documents", documents.schema).orderBy("source_month").collect()
    assert len(back) == 12 and {len(r.lines) for r in back} == {18} and {r.generator for r in back} == {"maker"}
    assert back[0].lines[0].fact == "Latest month: 2023-01-01" and back[0].generated_at is not None
    assert back[5].summary == "\n".join(x.fact for x in back[5].lines)
    sheet = {(r.source_month, r.fact_id): r.fact for r in snapshot.fact_sheet(s.facts, s.report).collect()}
    assert {(r.source_month, x.fact_id): x.fact for r in back for x in r.lines} == sheet
