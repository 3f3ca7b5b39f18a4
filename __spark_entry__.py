
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402
from pyspark.sql.types import DecimalType, IntegerType  # noqa: E402

from oracle.sql import ORACLES  # noqa: E402
from revspan import Calendar, MetricSuite, Tables  # noqa: E402
from revspan.operators import (  # noqa: E402
    audits, charts, cohorts, explore, hypothesis, panel, segments, snapshot, timeline, waterfall,
)
from revspan.plans import testbed  # noqa: E402
from revspan.plans.audited import store_with_audits  # noqa: E402
from revspan.plans.named_sql import SQL_METRICS, run_sql  # noqa: E402
from revspan.sources import tables as io  # noqa: E402
from revspan.sources.refresh import Warehouse  # noqa: E402
from revspan.sources.schemas import TABLES  # noqa: E402
from revspan.sources.shared import scratch_path, stored  # noqa: E402

try:  # the text operators may be left out
    import corpus_pipeline
    from revspan.llm import queries as text_queries

    TEXT_QUERIES = {**text_queries.QUERIES, "pipeline": corpus_pipeline.run}
    TEXT_ORACLES = text_queries.ORACLES
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "revspan.llm"):  # a library that is missing is not left out quietly
        raise
    TEXT_QUERIES, TEXT_ORACLES = {}, {}

Query = Callable[[SparkSession, str], DataFrame]


def _report(df: DataFrame) -> DataFrame:
    """Results leave as BIGINT and DOUBLE; every rounding has already been done in decimals."""
    kinds = {DecimalType: "double", IntegerType: "bigint"}
    return df.select(*[
        F.col(f.name).cast(kinds[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in kinds else F.col(f.name)
        for f in df.schema.fields
    ])


#: Queries over accounts, subscriptions and events alone; for them no calendar is looked up.
_WITHOUT_CALENDAR = frozenset((
    "subscription_timeline", "cohort_assignment", "cohort_sizes", "logo_churn_by_tier",
    "logo_churn_by_industry", "segment_contingency", "chi_square_segments", "z_test_segments",
    "segment_extremes", "segment_domain", "segment_churn_series", "segment_comparison",
    "duplicate_keys", "reused_keys", "overlap_rate", "signup_gap", "orphans", "constraints",
    "coverage", "churn_reconciliation",
))


def _on_suite(name: str, build: Callable[[MetricSuite], DataFrame]) -> Query:
    resolved = name not in _WITHOUT_CALENDAR
    return lambda spark, sf_dir: _report(build(testbed.suite(spark, sf_dir, resolved)))


def _spans_once(build: Callable[[MetricSuite], DataFrame]) -> Callable[[MetricSuite], DataFrame]:
    """For queries over several span metrics: read the spans that were stored for these source files, or
    store them, instead of deriving them for each metric, which would prune other columns and share no shuffle."""
    return lambda s: build(s.with_cached_spans())


def _timeline(s: MetricSuite) -> DataFrame:
    return timeline.subscription_timeline(s.tables.subscriptions.select(
        "subscription_id", "account_id", "start_date", "end_date", "plan_tier", "mrr_amount",
        "upgrade_flag", "downgrade_flag", "churn_flag",
    ))


def _calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar as a lazy plan over the orders, bounds included."""
    return testbed.calendar(testbed.Source(spark, sf_dir)).months(spark)


def _sql_over_views(s: MetricSuite) -> DataFrame:
    """What a SQL user asks of the views: revenue moved, by month and kind of movement."""
    s.create_views()
    return s.spark.sql("""
        SELECT c.month_start, c.month_end, m.movement_type, count(*) AS n_accounts,
               sum(m.mrr_delta) AS moved
        FROM account_mrr_changes m JOIN calendar_months c USING (month_start)
        WHERE m.movement_type <> 'unchanged'
        GROUP BY c.month_start, c.month_end, m.movement_type
    """)


def _provenance(s: MetricSuite) -> DataFrame:
    sheet = snapshot.fact_sheet(s.facts, s.report, s.tier, s.attribute)
    return snapshot.with_provenance(sheet, "revspan").groupBy("source_month", "generator").agg(
        F.count("*").alias("n_facts"), F.bool_and(F.col("generated_at").isNotNull()).alias("is_dated")
    )


def _requests(s: MetricSuite) -> DataFrame:
    return explore.yearly_requests(s.churn, s.calendar)


def _round_growth(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("growth_pct", F.round("growth_pct", 4))


def _heatmap(s: MetricSuite) -> DataFrame:
    return cohorts.cohort_heatmap(s.retention)


def _flat_snapshot(documents: DataFrame) -> DataFrame:
    """The nested document spread over columns, as both engines can compare it."""
    def listing(records: str) -> F.Column:
        return F.array_join(F.transform(records, lambda r: F.concat_ws(
            ":", F.coalesce(r.segment, F.lit("-")), r.n_accounts, r.n_churned, r.churn_rate_pct.cast("double")
        )), ";")

    chi, z = "hypothesis_tests.plan_tier_chi_square", "hypothesis_tests.industry_churn_ztest"
    nested = ("plan_tier_churn", "industry_churn", "hypothesis_tests")
    return documents.select(
        *[c for c in documents.columns if c not in nested],
        listing("plan_tier_churn").alias("plan_tier_churn"),
        listing("industry_churn").alias("industry_churn"),
        F.col(f"{chi}.chi2"), F.col(f"{chi}.dof"), F.col(f"{chi}.p_value").alias("chi2_p_value"),
        F.col(f"{chi}.significant").alias("chi2_significant"),
        *[F.col(f"{z}.{c}") for c in ("segment_a", "segment_b", "churn_pct_a", "churn_pct_b", "z")],
        F.col(f"{z}.p_value").alias("z_p_value"), F.col(f"{z}.significant").alias("z_significant"),
    )


def _snapshot_json(s: MetricSuite) -> DataFrame:
    path = scratch_path(s.spark, "snapshots")
    s.export_snapshots(path)
    return _flat_snapshot(io.read_documents(s.spark, path, s.snapshots.schema))


def _metric_csv(s: MetricSuite) -> DataFrame:
    path = scratch_path(s.spark, "mrr_waterfall")
    io.write_csv(s.run("mrr_waterfall"), path, single_file=True)
    return io.read_metric_csv(s.spark, path, s.waterfall.schema)


#: Of each exported metric, the column that is summed when it has been read back.
_EXPORTED = {
    "mrr_waterfall": "ending_mrr", "gross_net_churn_and_nrr": "nrr_pct",
    "cohort_retention": "retention_pct", "segment_plan_tier_churn": "churn_rate_pct",
    "segment_monthly_mrr": "avg_mrr_per_account", "segment_industry_churn": "churn_rate_pct",
    "segment_monthly_industry_mrr": "avg_mrr_per_account",
}


def _totals(metrics: dict[str, DataFrame]) -> DataFrame:
    return audits.stack([
        metrics[name].select(
            F.lit(name).alias("metric"), F.col(measure).cast("decimal(38,2)").alias("measure")
        ).groupBy("metric").agg(
            F.count("*").alias("n_rows"), F.count("measure").alias("n_measured"),
            F.sum("measure").alias("total"),
        )
        for name, measure in _EXPORTED.items()
    ])


def _metric_exports(s: MetricSuite) -> DataFrame:
    """All exported metrics, scanned back: rows, measured rows and the measure's total of each."""
    path = scratch_path(s.spark, "metrics")
    s.export_csv(path)
    return _totals({
        name: io.read_metric_csv(s.spark, f"{path}/{name}", s.run(name).schema) for name in _EXPORTED
    })


def _sql_metrics(s: MetricSuite) -> DataFrame:
    """The seven metrics run by name from their SQL: rows, measured rows and the measure's total of each."""
    s.create_views()
    return _totals({name: run_sql(s.spark, name) for name in SQL_METRICS})


def _sql_in_range(s: MetricSuite) -> DataFrame:
    return s.run_sql("mrr_waterfall", first_month=date(1997, 3, 1), last_month=date(1998, 6, 1))


def _refresh_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes, the first before the subscriptions since 1997 were there; what either version says."""
    source = testbed.Source(spark, sf_dir)
    root = scratch_path(spark, "warehouse")
    warehouse = Warehouse(spark, root)

    def metrics(loaded: dict[str, DataFrame]) -> dict[str, DataFrame]:
        months = Calendar.covering(loaded["subscriptions"], "start_date").resolve(spark)
        return {"mrr_waterfall": MetricSuite(Tables(loaded["accounts"], loaded["subscriptions"]), months).waterfall}

    subscriptions = testbed.as_declared(testbed.subscriptions(source), "subscriptions")
    io.write_csv(testbed.as_declared(testbed.accounts(source), "accounts"), f"{root}/in/accounts")
    for version, delivered in enumerate((subscriptions.where("start_date < '1997-01-01'"), subscriptions), 1):
        io.write_csv(delivered, f"{root}/in/subscriptions-{version}")
        warehouse.refresh(
            {"accounts": f"{root}/in/accounts", "subscriptions": f"{root}/in/subscriptions-{version}"}, metrics)
    measures = {"accounts": F.lit(0), "subscriptions": F.col("mrr_amount"), "mrr_waterfall": F.col("ending_mrr")}
    return _report(audits.stack([
        table.select(measures[name].cast("decimal(38,2)").alias("measure")).agg(
            F.count("*").alias("n_rows"), F.sum("measure").alias("total")
        ).select(F.lit(version).alias("version"), F.lit(name).alias("table_name"), "*")
        for version in warehouse.versions() for name, table in warehouse.open(version).items()
    ]))


def _dense_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feature_usage")
    usage = testbed.feature_usage(testbed.Source(spark, sf_dir))
    io.write_csv(testbed.as_declared(usage, "feature_usage"), path)
    loaded = io.load_table(spark, path, TABLES["feature_usage"], f"{path}-table")
    return _report(loaded.select("usage_pk", "usage_date", "subscription_id", "usage_id"))


def _kpis_from_store(s: MetricSuite) -> DataFrame:
    """The segment tiles of 1997, by month partitions of the stored segment table."""
    path = scratch_path(s.spark, "segment_monthly")
    io.write_by_month(s.segment_monthly, path)
    of_1997 = (F.col("start_month") == "1997-01-01") & (F.col("end_month") == "1997-12-01")
    requests = stored(_requests(s).where(of_1997), "requests")
    return _round_growth(explore.segment_kpis_from_store(
        requests, s.spark.read.parquet(path), s.churn, s.monthly, s.calendar))


def _summary_documents(s: MetricSuite) -> DataFrame:
    """One document per month, written and read back."""
    path = scratch_path(s.spark, "summaries")
    documents = snapshot.summary_documents(
        snapshot.numbered_facts(s.facts, s.report, s.tier, s.attribute), "revspan")
    io.write_documents(documents, path)
    return io.read_documents(s.spark, path, documents.schema).select(
        "source_month", "generator", F.col("generated_at").isNotNull().alias("is_dated"),
        F.size("lines").alias("n_lines"), F.array_join("lines.fact_id", ",").alias("fact_ids"), "summary")


def _csv_roundtrip(name: str, mapped: Callable[[testbed.Source], DataFrame]) -> Query:
    """A mapped table delivered as CSV and scanned back against its declared schema."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, name)
        table = mapped(testbed.Source(spark, sf_dir))
        io.write_csv(testbed.as_declared(table, name), path)
        return _report(io.read_table_csv(spark, path, TABLES[name]))

    return query


def _surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feature_usage")
    usage = testbed.feature_usage(testbed.Source(spark, sf_dir))
    io.write_csv(testbed.as_declared(usage, "feature_usage"), path)
    loaded = io.load_table(spark, path, TABLES["feature_usage"], f"{path}-table")
    return _report(loaded.groupBy("usage_pk").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_rows"),
        F.count("usage_pk").alias("n_distinct_keys"),
        F.count_if(F.col("usage_pk").isNull()).alias("n_null_keys"),
    ))


def _orphans(s: MetricSuite) -> DataFrame:
    t = s.tables
    references = [
        ("subscriptions", t.subscriptions, "account_id", t.accounts),
        ("support_tickets", t.support_tickets, "account_id", t.accounts),
        ("churn_events", t.churn_events, "account_id", t.accounts),
        ("feature_usage", t.feature_usage, "subscription_id", t.subscriptions),
    ]
    return audits.stack([
        audits.orphans(child, key, parent, key, f"{name}.{key}")
        for name, child, key, parent in references
    ])


def _constraints(s: MetricSuite) -> DataFrame:
    t = s.tables
    checked = {
        "accounts": t.accounts, "subscriptions": t.subscriptions,
        "support_tickets": t.support_tickets, "churn_events": t.churn_events,
        "feature_usage": io.with_surrogate_key(t.feature_usage, "usage_pk"),
    }
    return audits.stack([
        audits.constraint_profile(df, TABLES[name].primary_key, TABLES[name].not_null, name)
        for name, df in checked.items()
    ])


def _coverage(s: MetricSuite) -> DataFrame:
    t = s.tables
    return audits.stack([
        audits.coverage_profile(t.accounts, "signup_date", "accounts"),
        audits.coverage_profile(t.subscriptions, "start_date", "subscriptions"),
        audits.coverage_profile(t.feature_usage, "usage_date", "feature_usage"),
        audits.coverage_profile(t.support_tickets, "submitted_at", "support_tickets"),
        audits.coverage_profile(t.churn_events, "churn_date", "churn_events"),
    ])


_SUITE_QUERIES: dict[str, Callable[[MetricSuite], DataFrame]] = {
    # Building blocks
    "subscription_timeline": _timeline,
    "account_month_panel": lambda s: panel.account_month_panel(s.spans),
    "account_movements": lambda s: panel.account_movements(s.spans),
    "sql_over_views": _sql_over_views,
    "sql_metrics": _spans_once(_sql_metrics),
    "sql_metric_in_range": _sql_in_range,
    # Metrics
    "mrr_waterfall": lambda s: s.run("mrr_waterfall"),
    "mrr_waterfall_from_movements": lambda s: waterfall.waterfall_from_movements(
        panel.account_movements(s.spans)
    ),
    "gross_net_churn_nrr": lambda s: s.run("gross_net_churn_and_nrr"),
    "new_mrr_split": lambda s: waterfall.new_mrr_split(s.spans, s.calendar),
    "cohort_assignment": lambda s: cohorts.cohort_assignment(s.tables.subscriptions),
    "cohort_sizes": lambda s: cohorts.cohort_sizes(s.tables.subscriptions),
    "cohort_retention": lambda s: s.run("cohort_retention"),
    "logo_churn_by_tier": lambda s: s.run("segment_plan_tier_churn"),
    "logo_churn_by_industry": lambda s: s.run("segment_industry_churn"),
    "monthly_mrr_by_tier": lambda s: s.run("segment_monthly_mrr"),
    "monthly_mrr_by_industry": lambda s: s.run("segment_monthly_industry_mrr"),
    # Statistics
    "segment_contingency": lambda s: hypothesis.contingency(s.churn),
    "chi_square_segments": lambda s: hypothesis.chi_square_by_dimension(s.churn),
    "z_test_segments": lambda s: hypothesis.z_test_pairs(
        s.churn, hypothesis.extreme_pairs(s.churn)
    ),
    # Snapshot and fact sheet
    "segment_extremes": lambda s: hypothesis.segment_extremes(s.churn),
    "mom_change": lambda s: s.facts.select(
        "month_start", "ending_mrr", "prior_month_ending_mrr", "mrr_change_dollars",
        "mom_mrr_growth_pct",
    ),
    "latest_month_facts": lambda s: snapshot.latest_facts(s.facts),
    "period_mean_rates": lambda s: snapshot.period_mean_rates(s.monthly),
    "metrics_snapshot": lambda s: _flat_snapshot(s.snapshots),
    "snapshot_json_roundtrip": _snapshot_json,
    "fact_sheet": lambda s: snapshot.fact_sheet(s.facts, s.report, s.tier, s.attribute),
    "fact_provenance": _provenance,
    "summary_documents": _summary_documents,
    # Explorer
    "segment_domain": lambda s: segments.segment_domain(s.churn),
    "explorer_requests": _requests,
    "waterfall_in_range": lambda s: explore.in_range(s.waterfall, "1997-03-01", "1998-06-01"),
    "segment_in_range": lambda s: explore.segment_in_range(
        s.of_segment("BUILDING").by_attribute, "industry", "BUILDING", "1997-03-01", "1998-06-01"
    ),
    "measurable_rates": lambda s: waterfall.measurable_months(s.rates),
    "range_kpis_all": lambda s: _round_growth(
        explore.range_kpis(_requests(s), s.monthly, s.calendar)
    ).drop("dimension", "segment"),
    "range_kpis_segment": _spans_once(lambda s: _round_growth(explore.segment_range_kpis(
        _requests(s), s.segment_monthly, s.churn, s.monthly, s.calendar
    ))),
    "range_kpis_from_store": _spans_once(_kpis_from_store),
    "trend_series": _spans_once(lambda s: explore.trend_series(
        _requests(s), s.segment_monthly, s.monthly, s.calendar
    )),
    "segment_churn_series": lambda s: segments.segment_churn_series(s.churn, "industry"),
    # Chart data
    "waterfall_long": lambda s: charts.waterfall_long(s.waterfall),
    "rates_long": lambda s: charts.rates_long(s.rates),
    "waterfall_stack": lambda s: charts.waterfall_stack(s.waterfall),
    "cohort_heatmap": _heatmap,
    "segment_comparison": lambda s: segments.segment_comparison(s.churn),
    # Audits
    "duplicate_keys": lambda s: audits.stack([
        audits.duplicate_keys(s.tables.feature_usage, key, "feature_usage")
        for key in ("usage_id", "subscription_id")
    ]),
    "reused_keys": lambda s: audits.reused_key_rows(s.tables.feature_usage, "subscription_id"),
    "overlap_rate": lambda s: audits.overlap_rate(_timeline(s)),
    "signup_gap": lambda s: audits.signup_gap(s.tables.accounts, s.tables.subscriptions),
    "orphans": _orphans,
    "constraints": _constraints,
    "coverage": _coverage,
    "identity_breaks": lambda s: audits.identity_breaks(s.waterfall),
    "continuity_breaks": lambda s: audits.continuity_breaks(s.waterfall),
    "nrr_breaks": lambda s: audits.nrr_breaks(s.rates),
    "panel_uniqueness": lambda s: audits.panel_uniqueness(_timeline(s), s.calendar),
    "panel_completeness": lambda s: audits.panel_completeness(
        panel.account_month_panel(s.spans), s.tables.accounts, s.calendar
    ),
    "churn_reconciliation": lambda s: audits.churn_reconciliation(
        s.tables.accounts, s.tables.subscriptions, s.tables.churn_events
    ),
    "segment_tieout": _spans_once(lambda s: audits.segment_tieout(
        s.segment_monthly, s.waterfall, (s.tier, s.attribute)
    )),
    "audits_in_one_pass": lambda s: store_with_audits(s)[1],
    # Sinks and scans
    "metric_csv_roundtrip": _metric_csv,
    "metric_exports": _metric_exports,
}


def entry(spark: SparkSession) -> DataFrame:
    """The monthly revenue waterfall on the smallest tables."""
    return queries()["mrr_waterfall"](spark, "/root/testdata/sf0.001")


def core_queries() -> dict[str, Query]:
    return {
        **{name: _on_suite(name, build) for name, build in _SUITE_QUERIES.items()},
        "calendar_months": _calendar_months,
        "month_domain": lambda spark, d: explore.month_domain(_calendar_months(spark, d)),
        "csv_accounts": _csv_roundtrip(
            "accounts", lambda source: testbed.accounts(source, with_country=True)
        ),
        "csv_subscriptions": _csv_roundtrip("subscriptions", testbed.subscriptions),
        "csv_feature_usage": _csv_roundtrip("feature_usage", testbed.feature_usage),
        "csv_support_tickets": _csv_roundtrip("support_tickets", testbed.support_tickets),
        "csv_churn_events": _csv_roundtrip("churn_events", testbed.churn_events),
        "usage_surrogate_key": _surrogate_key,
        "usage_dense_key": _dense_key,
        "refresh_versions": _refresh_versions,
    }


def queries() -> dict[str, Query]:
    return core_queries() | TEXT_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | TEXT_ORACLES
