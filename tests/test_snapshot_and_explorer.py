"""Facts, documents, ranges and chart shapes on small hand-checked monthly tables."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revspan import Calendar
from revspan.functions.growth import growth_label, guarded_growth_pct
from revspan.operators import charts, explore, segments, snapshot
from revspan.operators.audits import continuity_breaks, identity_breaks, nrr_breaks
from revspan.operators.waterfall import measurable_months, revenue_rates, with_rates

WATERFALL = (
    "month_start date, starting_mrr decimal(22,2), new_mrr decimal(22,2), "
    "expansion_mrr decimal(22,2), contraction_mrr decimal(22,2), churned_mrr decimal(22,2), "
    "ending_mrr decimal(22,2)"
)


def monthly(spark, *rows):
    return spark.createDataFrame(
        [(date.fromisoformat(r[0]), *[Decimal(str(v)) for v in r[1:]]) for r in rows], WATERFALL
    )


@pytest.fixture(scope="module")
def waterfall(spark):
    return monthly(
        spark,
        ("2024-10-01", 0, 1000, 0, 0, 0, 1000),
        ("2024-11-01", 1000, 2562, 300, -100, -100, 3662),
        ("2024-12-01", 3662, 10, 0, 0, -22, 3650),
    )


def test_rates(spark, waterfall):
    rows = revenue_rates(waterfall).orderBy("month_start").collect()
    assert rows[0].gross_mrr_churn_rate_pct is None and rows[0].nrr_pct is None
    r = rows[1]
    assert [float(v) for v in (r.gross_mrr_churn_rate_pct, r.net_mrr_churn_rate_pct, r.nrr_pct)] == [
        20.0, -10.0, 110.0]
    assert measurable_months(revenue_rates(waterfall)).count() == 2


def test_rounding_is_exact_for_wide_sums(spark):
    # 5.505 exactly: half up is 5.51; a quotient cut to six places first must not matter.
    df = monthly(spark, ("2024-01-01", "200000.00", 0, 0, "-11010.00", 0, "188990.00"))
    assert float(revenue_rates(df).first().gross_mrr_churn_rate_pct) == 5.51
    # 33497992.16 of it lost 1847398.68 -> 5.51496..., which must not climb to 5.52.
    df = monthly(spark, ("2024-01-01", "33497992.16", 0, 0, "-417429.41", "-1429979.27", "31650583.48"))
    assert float(revenue_rates(df).first().gross_mrr_churn_rate_pct) == 5.51


def test_identities(spark, waterfall):
    assert identity_breaks(waterfall).first().n_breaks == 0
    assert continuity_breaks(waterfall).first().n_breaks == 0
    assert nrr_breaks(revenue_rates(waterfall)).first().n_breaks == 0
    broken = waterfall.withColumn("new_mrr", F.col("new_mrr") + 1)
    assert identity_breaks(broken).first().n_breaks == 3
    moved = waterfall.withColumn("ending_mrr", F.col("ending_mrr") + 1)
    assert continuity_breaks(moved).first().asDict() == {"n_pairs": 2, "n_breaks": 2}


@pytest.fixture(scope="module")
def churn(spark):
    accounts = spark.createDataFrame(
        [("T1", "I1", True), ("T1", "I2", False), ("T2", "I2", False), ("T2", "I1", True)],
        "plan_tier string, industry string, churn_flag boolean",
    )
    return segments.logo_churn_by_dimension(accounts, ["plan_tier", "industry"])


def test_facts_and_document(spark, waterfall, churn):
    facts = snapshot.monthly_facts(with_rates(waterfall))
    last = snapshot.latest_facts(facts).first()
    assert last.month_start == date(2024, 12, 1)
    assert float(last.mrr_change_dollars) == -12 and float(last.mom_mrr_growth_pct) == -0.33
    # Means of 20.00 and 0.60, of -10.00 and 0.60, of 110.00 and 99.40.
    assert [float(last[c]) for c in snapshot.PERIOD_MEANS] == [10.3, -4.7, 104.7]
    means = snapshot.period_mean_rates(with_rates(waterfall)).first()
    assert [float(v) for v in means] == [10.3, -4.7, 104.7]

    report = snapshot.segment_report(churn)
    doc = snapshot.metrics_snapshot(facts, report).orderBy(F.desc("latest_month")).first()
    assert len(doc) == 18
    assert [r.segment for r in doc.plan_tier_churn] == ["T1", "T2"]
    assert [(r.segment, float(r.churn_rate_pct)) for r in doc.industry_churn] == [
        ("I1", 100.0), ("I2", 0.0)]
    tests = doc.hypothesis_tests
    assert tests.plan_tier_chi_square.dof == 1 and tests.plan_tier_chi_square.significant is False
    assert tests.industry_churn_ztest.segment_a == "I1" and tests.industry_churn_ztest.z == 2.0
    assert tests.industry_churn_ztest.p_value == 0.0455


def test_fact_sheet(spark, waterfall, churn):
    facts = snapshot.monthly_facts(with_rates(waterfall))
    sheet = snapshot.fact_sheet(facts, snapshot.segment_report(churn))
    text = {(str(r.source_month), r.fact_id): r.fact for r in sheet.collect()}
    assert text["2024-12-01", "ending_mrr"] == "Ending MRR: $3,650"
    assert text["2024-12-01", "mrr_change"] == "Dollar change vs prior month: $-12"
    assert text["2024-12-01", "mom_growth"] == "Month-over-month MRR growth: -0.33%"
    assert text["2024-10-01", "prior_ending_mrr"] == "Prior month ending MRR: n/a"
    assert text["2024-12-01", "period_average"] == (
        "Full 3-month average: gross churn 10.3%, net churn -4.7%, NRR 104.7%")
    assert text["2024-12-01", "industry_highest"] == "Highest-churn industry: I1 at 100.0%"
    assert text["2024-12-01", "tier_test"].endswith("the tiers are essentially tied")
    assert "(statistically significant)" in text["2024-12-01", "industry_test"]
    assert all(v is not None for v in text.values())
    stamped = snapshot.with_provenance(sheet, "tests").first()
    assert stamped.generated_at is not None and stamped.generator == "tests"


@pytest.mark.parametrize("start, end, pct, label", [
    (0, 5000, None, "n/a (base too small)"),
    (None, 5000, None, "n/a (base too small)"),
    ("1999.99", 5000, None, "n/a (base too small)"),
    (-5, 5000, None, "n/a (base too small)"),
    (2000, 2000, 0.0, "0.0%"),
    (2000, 3000, 50.0, "50.0%"),
    (2000, 2505, 25.25, "25.3%"),  # half up
    (4000, 3000, -25.0, "-25.0%"),
])
def test_guarded_growth(spark, start, end, pct, label):
    row = spark.createDataFrame(
        [(None if start is None else Decimal(start), Decimal(end))],
        "s decimal(22,2), e decimal(22,2)",
    )
    got = row.select(guarded_growth_pct(F.col("s"), F.col("e")).alias("p")).withColumn(
        "l", growth_label(F.col("p"))).first()
    assert (None if got.p is None else float(got.p)) == pct and got.l == label


def test_range_kpis(spark, waterfall, churn):
    calendar = Calendar.between("2024-10-01", "2024-12-01")
    requests = spark.createDataFrame([
        ("r1", "all", None, date(2024, 11, 1), date(2024, 12, 1)),
        ("r2", "all", None, date(2020, 1, 1), date(2030, 1, 1)),
        ("r3", "plan_tier", "T1", date(2024, 10, 1), date(2024, 12, 1)),
        ("r4", "plan_tier", "T2", date(2024, 10, 1), date(2024, 10, 1)),
        ("r5", "industry", "I1", date(2019, 1, 1), date(2019, 2, 1)),
    ], "request_id string, dimension string, segment string, start_month date, end_month date")
    rates = with_rates(waterfall)
    rows = {r.request_id: r for r in explore.range_kpis(requests, rates, calendar).collect()}
    assert set(rows) == {"r1", "r2"}
    assert float(rows["r1"].ending_mrr) == 3650 and float(rows["r1"].range_start_mrr) == 1000
    assert rows["r1"].growth_label == "n/a (base too small)"
    assert float(rows["r2"].avg_gross_churn_pct) == 10.3

    by_segment = spark.createDataFrame([
        ("plan_tier", "T1", date(2024, 11, 1), 3, Decimal(2000)),  # no row in October
        ("plan_tier", "T1", date(2024, 12, 1), 4, Decimal(3000)),
    ], "dimension string, segment string, month_start date, active_accounts bigint, total_mrr decimal(22,2)")
    rows = {r.request_id: r for r in explore.segment_range_kpis(
        requests, by_segment, churn, rates, calendar).collect()}
    assert set(rows) == {"r3", "r4", "r5"}
    assert rows["r3"].growth_label == "50.0%" and float(rows["r3"].logo_churn_pct) == 50.0
    assert float(rows["r3"].business_avg_nrr_pct) == 104.7
    assert float(rows["r4"].ending_mrr) == 0 and rows["r4"].growth_pct is None
    assert float(rows["r5"].ending_mrr) == 0 and rows["r5"].business_avg_nrr_pct is None

    line = explore.trend_series(requests, by_segment, rates, calendar).where("request_id = 'r3'")
    assert [float(r.mrr) for r in line.orderBy("month_start").collect()] == [2000, 3000]
    assert explore.trend_series(requests, by_segment, rates, calendar).where(
        "request_id = 'r2'").count() == 3


def test_domains_and_requests(spark, waterfall, churn):
    months = {r.month for r in explore.month_domain(waterfall).collect()}
    assert months == {"2024-10", "2024-11", "2024-12"}
    assert segments.segment_domain(churn).count() == 4
    calendar = Calendar.between("2024-10-01", "2025-03-01")
    requests = explore.yearly_requests(churn, calendar)
    spans = {(str(r.start_month), str(r.end_month))
             for r in requests.where("dimension = 'all'").collect()}
    assert spans == {("2024-10-01", "2024-12-01"), ("2025-01-01", "2025-03-01"),
                     ("2024-10-01", "2025-03-01")}
    assert requests.count() == 15


def test_chart_shapes(spark, waterfall, churn):
    assert charts.waterfall_long(waterfall).count() == 12
    assert charts.rates_long(revenue_rates(waterfall)).count() == 4
    stack = charts.waterfall_stack(waterfall).orderBy("month_start").collect()[1]
    assert stack.expansion_bottom == stack.new_mrr and stack.churned_bottom == stack.contraction_mrr
    bars = segments.segment_churn_series(churn, "industry").orderBy("position").collect()
    assert [b.segment for b in bars] == ["I1", "I2"]
    assert explore.in_range(waterfall, "2024-11-01", "2024-12-01").count() == 2
