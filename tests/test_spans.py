"""Timelines, panels, movements, waterfalls and cohorts against brute force and hand-made cases."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revspan import Calendar, MetricSuite
from revspan.functions import money
from revspan.operators.cohorts import cohort_assignment, cohort_heatmap, cohort_sizes
from revspan.operators.panel import account_month_panel, account_movements
from revspan.operators.timeline import subscription_timeline
from revspan.operators.waterfall import waterfall_from_movements
from tests import reference_model as model
from tests.conftest import day, make_tables

HALF_YEAR = ("2023-01-01", "2023-06-01")

# name -> subscriptions (id, start, end, amount) and the month-end revenue of Jan..Jun
CASES = {
    "open": ([("s", "01-10", None, 100)], [100] * 6),
    "closed_mid_month": ([("s", "01-10", "03-15", 100)], [100, 100, 0, 0, 0, 0]),
    "closed_on_month_end": ([("s", "01-10", "03-31", 100)], [100, 100, 100, 0, 0, 0]),
    "inside_one_month": ([("s", "02-03", "02-20", 100)], [0] * 6),
    "superseded": (
        [("s", "01-10", None, 100), ("t", "03-05", None, 250)], [100, 100, 250, 250, 250, 250]),
    "no_resume": (
        [("s", "01-10", None, 100), ("t", "02-05", "03-10", 250)], [100, 250, 0, 0, 0, 0]),
    "end_after_successor": (
        [("s", "01-10", "05-20", 100), ("t", "03-05", None, 50)], [100, 100, 50, 50, 50, 50]),
    "gap_then_return": (
        [("s", "01-10", "02-10", 100), ("t", "04-02", None, 100)], [100, 0, 0, 100, 100, 100]),
    "same_day": ([("A", "01-10", None, 100), ("B", "01-10", None, 70)], [70] * 6),
    "end_before_start": ([("s", "03-05", "02-01", 100)], [0] * 6),
    "trial": ([("s", "01-10", None, 0)], [0] * 6),
    "null_amount": ([("s", "01-10", None, None)], [0] * 6),
    "no_subscription": ([], [0] * 6),
    "starts_before": ([("s", "2022-11-10", None, 100)], [100] * 6),
    "starts_after": ([("s", "2023-07-02", None, 100)], [0] * 6),
    "two_before": (
        [("s", "2022-10-10", None, 100), ("t", "2022-11-10", "01-31", 60)], [60, 0, 0, 0, 0, 0]),
    "before_and_in_first_month": (
        [("s", "2022-12-10", None, 100), ("t", "01-20", None, 60)], [60] * 6),
    "negative": ([("s", "02-01", "03-31", -10)], [0, -10, -10, 0, 0, 0]),
    "expansion": ([("s", "01-10", None, 100), ("t", "03-05", None, 150)], [100, 100] + [150] * 4),
    "leap_end": ([("s", "2023-01-05", "2023-02-28", 5)], [5, 5, 0, 0, 0, 0]),
}


@pytest.fixture(scope="module")
def hand_made(spark):
    accounts = [(name, "X", "Pro", False) for name in CASES]
    subs = [(f"{name}.{s[0]}", name, s[1], s[2], s[3])
            for name, (rows, _) in CASES.items() for s in rows]
    suite = MetricSuite(make_tables(spark, accounts, subs), Calendar.between(*HALF_YEAR))
    cells = account_month_panel(suite.spans).collect()
    moves = account_movements(suite.spans).collect()
    return suite, cells, moves


@pytest.mark.parametrize("case", CASES)
def test_month_end_revenue(hand_made, case):
    got = [r.mrr for r in sorted(hand_made[1], key=lambda r: r.month_start) if r.account_id == case]
    assert got == CASES[case][1]


def kinds(hand_made, case):
    rows = sorted(hand_made[2], key=lambda r: r.month_start)
    return [r.movement_type for r in rows if r.account_id == case]


def test_movements_of_a_returning_account(hand_made):
    assert kinds(hand_made, "gap_then_return") == [
        "new", "churned", "unchanged", "new", "unchanged", "unchanged"]


def test_movements_of_an_early_start_begin_as_new(hand_made):
    assert kinds(hand_made, "starts_before")[0] == "new"
    assert kinds(hand_made, "before_and_in_first_month")[0] == "new"


def test_negative_revenue_follows_the_sign_of_the_change(hand_made):
    assert kinds(hand_made, "negative") == [
        "unchanged", "contraction", "unchanged", "expansion", "unchanged", "unchanged"]


def test_unpaid_subscriptions_still_show_their_tier(hand_made):
    tier = {(r.account_id, r.month_start.month): r.plan_tier for r in hand_made[1]}
    assert tier["trial", 3] == "Pro" and tier["null_amount", 3] == "Pro"
    assert tier["no_subscription", 3] is None


def test_timeline_columns(hand_made):
    rows = {r.subscription_id: r for r in
            subscription_timeline(hand_made[0].tables.subscriptions).collect()}
    assert rows["open.s"].effective_end_date is None
    assert rows["superseded.s"].effective_end_date == day("03-04")
    assert rows["superseded.s"].next_start_date == day("03-05")
    assert rows["end_after_successor.s"].effective_end_date == day("03-04")
    assert rows["same_day.A"].effective_end_date == day("01-09")
    assert rows["same_day.B"].effective_end_date is None
    assert len(rows) == sum(len(r) for r, _ in CASES.values())


def test_trials_count_by_tier_but_not_by_industry(hand_made):
    suite = hand_made[0]
    june = F.col("month_start") == "2023-06-01"
    by_tier = suite.by_tier.where(june).first()
    by_industry = suite.by_attribute.where(june).first()
    assert by_tier.active_accounts == by_industry.active_accounts + 2  # trial, null_amount
    assert by_tier.total_mrr == by_industry.total_mrr


def test_cohorts_of_the_hand_made_accounts(hand_made):
    suite = hand_made[0]
    early = suite.retention.where("cohort_month = '2022-11-01'").orderBy("months_since_signup")
    assert [r.months_since_signup for r in early.collect()] == [2, 3, 4, 5, 6, 7]
    assert suite.retention.where("cohort_month = '2023-07-01'").count() == 0
    sizes = {r.cohort_month: r.cohort_size
             for r in cohort_sizes(suite.tables.subscriptions).collect()}
    assert sizes[date(2023, 7, 1)] == 1
    assigned = {r.account_id for r in cohort_assignment(suite.tables.subscriptions).collect()}
    assert "no_subscription" not in assigned


def test_retention_can_rise_again_and_pivots(spark):
    tables = make_tables(
        spark, [("a", "X", "Pro", False), ("b", "X", "Pro", False)],
        [("1", "a", "01-05", None, 10), ("2", "b", "01-06", "02-10", 10), ("3", "b", "03-01", None, 10)],
    )
    suite = MetricSuite(tables, Calendar.between("2023-01-01", "2023-03-01"))
    rows = suite.retention.orderBy("months_since_signup").collect()
    assert [float(r.retention_pct) for r in rows] == [100.0, 50.0, 100.0]
    wide = cohort_heatmap(suite.retention)
    assert wide.columns == ["cohort", "m0", "m1", "m2"]
    assert (wide.first().cohort, float(wide.first().m1)) == ("2023-01", 50.0)


def test_the_heatmap_holds_cohorts_from_before_the_calendar(spark):
    tables = make_tables(spark, [("a", "X", "Pro", False)], [("1", "a", "2022-10-05", None, 10)])
    suite = MetricSuite(tables, Calendar.between("2023-01-01", "2023-03-01"))
    row = cohort_heatmap(suite.retention).first()
    assert [row[f"m{i}"] is not None for i in range(6)] == [False] * 3 + [True] * 3


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_rates_of_totals_beyond_ten_to_the_sixteenth(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        row = spark.sql("SELECT CAST('-300000000000000000.05' AS DECIMAL(38,2)) AS n, CAST('700000000000000000.00' AS DECIMAL(38,2)) AS d, 3L AS k").select(
            money.percent(F.col("n"), F.col("d"), 2).alias("pct"), money.mean_amount(F.col("d"), F.col("k")).alias("mean"),
            money.percent(F.col("n"), F.col("d") - F.col("d"), 2).alias("none")).first()
        assert (str(row.pct), str(row.mean), row.none) == ("-42.86", "233333333333333333.33", None)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_numbers_are_never_shown_with_an_exponent(spark):
    values = spark.createDataFrame([(0.0003,), (12345678.9,), (5.0,), (17.58,), (None,)], "v double")
    assert [r.t for r in values.select(money.plain_number(F.col("v")).alias("t")).collect()] == ["0.0003", "12345678.9", "5.0", "17.58", None]


def random_subscriptions(rng, n_accounts, n_rows):
    rows = []
    for i in range(n_rows):
        # A third of all rows belongs to one account.
        account = "a0" if rng.random() < 1 / 3 else f"a{rng.randrange(n_accounts + 2)}"
        start = date(2022, 10, 1) + timedelta(days=rng.randrange(500))
        end = rng.choice([None, start + timedelta(days=rng.randrange(-20, 200)),
                          model.month_end(start.replace(day=1))])
        amount = rng.choice([None, Decimal(0), Decimal(rng.randrange(1, 5) * 100), Decimal("19.99")])
        rows.append((f"s{i:04d}", account, start, end, amount, rng.choice(["Basic", "Pro", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_intervals_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 25
    subs = random_subscriptions(rng, n, 300)  # two of the accounts are unknown
    ids = [f"a{i}" for i in range(n)]
    industry = {a: rng.choice(["X", "Y", None]) for a in ids}
    tables = make_tables(
        spark, [(a, industry[a], "Pro", False) for a in ids],
        [(s[0], s[1], s[2].isoformat(), s[3].isoformat() if s[3] else None, s[4], s[5]) for s in subs],
    )
    first, last = date(2023, 1, 1), date(2023, 12, 1)
    suite = MetricSuite(tables, Calendar.between(first, last)).with_stored_spans()

    ends = model.timeline(subs)
    got = {r.subscription_id: (r.next_start_date, r.effective_end_date)
           for r in subscription_timeline(tables.subscriptions).collect()}
    assert got == ends

    cells = model.panel(ids, subs, first, last)
    got = {(r.account_id, r.month_start): (r.mrr, r.plan_tier)
           for r in account_month_panel(suite.spans).collect()}
    assert got == cells

    moves = model.movements(cells, ids, first, last)
    dense = account_movements(suite.spans)
    got = {(r.account_id, r.month_start): (r.prior_mrr, r.current_mrr, r.movement_type)
           for r in dense.collect()}
    assert got == moves

    expected = model.waterfall(moves, first, last)
    for form in (suite.waterfall, waterfall_from_movements(dense)):
        got = {r.month_start: (r.starting_mrr, r.new_mrr, r.expansion_mrr, r.contraction_mrr,
                               r.churned_mrr, r.ending_mrr) for r in form.collect()}
        assert got == expected

    got = {(r.cohort_month, r.months_since_signup): (r.cohort_size, r.active_accounts)
           for r in suite.retention.collect()}
    assert got == model.retention(cells, ids, subs, first, last)

    by_tier, by_industry = {}, {}
    for (a, m), (amount, tier) in cells.items():
        if tier is not None:
            k, t = by_tier.get((m, tier), (0, Decimal(0)))
            by_tier[m, tier] = (k + 1, t + amount)
        k, t = by_industry.get((m, industry[a]), (0, Decimal(0)))
        by_industry[m, industry[a]] = (k + (amount > 0), t + amount)
    got = {(r.month_start, r.plan_tier): (r.active_accounts, r.total_mrr)
           for r in suite.by_tier.collect()}
    assert got == by_tier
    got = {(r.month_start, r.industry): (r.active_accounts, r.total_mrr)
           for r in suite.by_attribute.collect()}
    assert got == by_industry


def test_a_busy_account_leaves_one_row_per_month(spark):
    rng = random.Random(9)
    subs = [(f"s{i:05d}", "busy", (date(2023, 1, 1) + timedelta(days=rng.randrange(181))).isoformat(),
             None, Decimal(i)) for i in range(5000)]
    tables = make_tables(spark, [("busy", "X", "Pro", False)], subs)
    suite = MetricSuite(tables, Calendar.between(*HALF_YEAR)).with_stored_spans()
    assert suite.spans.count() <= 7  # six months and the opening row
    assert suite.with_stored_spans() is suite
    last = {s[2][:7]: s[4] for s in sorted(subs, key=lambda s: (s[2], s[0]))}
    panel = {str(r.month_start)[:7]: r.mrr for r in account_month_panel(suite.spans).collect()}
    assert panel == last


def test_the_calendar_can_come_from_the_data(spark):
    tables = make_tables(spark, [("a", "X", "Pro", False)],
                         [("1", "a", "2023-02-10", None, 5), ("2", "a", "2023-04-10", None, 7)])
    lazy = Calendar.covering(tables.subscriptions, "start_date")
    assert [str(r.month_start) for r in lazy.months(spark).orderBy("month_start").collect()] == [
        "2023-02-01", "2023-03-01", "2023-04-01"]
    assert lazy.n_months(spark) == 3 and lazy.resolve(spark).is_pinned
    rows = MetricSuite(tables, lazy).waterfall.orderBy("month_start").collect()
    assert [r.ending_mrr for r in rows] == [5, 5, 7]
    empty = Calendar.covering(tables.subscriptions.limit(0), "start_date")
    with pytest.raises(ValueError):
        empty.resolve(spark)
