"""The metric suite: the source tables wired to the operators, and the registry of metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from revspan.functions.calendar import Calendar
from revspan.operators import cohorts, panel, segments, snapshot, waterfall
from revspan.operators.spans import account_spans
from revspan.operators.timeline import subscription_timeline
from revspan.plans.named_sql import create_functions, run_sql
from revspan.sources.shared import shared_folder, stored
from revspan.sources.span_cache import cached_spans
from revspan.sources.tables import write_csv, write_documents


@dataclass(frozen=True)
class Tables:
    accounts: DataFrame
    subscriptions: DataFrame
    feature_usage: DataFrame | None = None
    support_tickets: DataFrame | None = None
    churn_events: DataFrame | None = None


@dataclass(frozen=True)
class MetricSuite:
    """Lazy metric tables over one set of source tables.

    Every revenue metric reads ``spans``. Asking for many metrics, store those first with
    ``with_stored_spans``; asking for one, leave them in its plan.
    """

    tables: Tables
    calendar: Calendar
    tier: str = "plan_tier"
    attribute: str = "industry"
    stored_spans: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tables.accounts.sparkSession

    @cached_property
    def spans(self) -> DataFrame:
        if self.stored_spans is not None:
            return self.stored_spans
        return account_spans(
            self.tables.accounts, self.tables.subscriptions, self.calendar, (self.attribute,)
        )

    def with_stored_spans(self) -> MetricSuite:
        """The same suite with its spans written to the shared folder, once."""
        if self.stored_spans is not None:
            return self
        pinned = self.calendar.resolve(self.spark)
        return replace(
            self, calendar=pinned,
            stored_spans=stored(replace(self, calendar=pinned).spans, "spans"),
        )

    def with_cached_spans(self, folder: str | None = None) -> MetricSuite:
        """The same suite with its spans from ``folder`` (by default in the shared folder): written there
        only if no session has done so for the same source files and calendar."""
        if self.stored_spans is not None:
            return self
        pinned = self.calendar.resolve(self.spark)
        folder = folder or f"{shared_folder(self.spark).rstrip('/')}/revspan-spans"
        found = cached_spans(
            self.tables.accounts, self.tables.subscriptions, pinned, self.attribute, folder)
        return replace(self, calendar=pinned, stored_spans=found)

    def of_segment(self, value: str) -> MetricSuite:
        """The suite of the accounts whose attribute has this value: other accounts and their
        subscriptions are left out before anything is ordered."""
        accounts = self.tables.accounts.where(F.col(self.attribute) == value)
        subscriptions = self.tables.subscriptions.join(
            accounts.select("account_id"), "account_id", "left_semi"
        )
        return replace(self, tables=Tables(accounts, subscriptions), stored_spans=None)

    @cached_property
    def waterfall(self) -> DataFrame:
        return waterfall.mrr_waterfall(self.spans, self.calendar)

    @cached_property
    def rates(self) -> DataFrame:
        return waterfall.revenue_rates(self.waterfall)

    @cached_property
    def monthly(self) -> DataFrame:
        """The waterfall and its rates in one row per month."""
        return waterfall.with_rates(self.waterfall)

    @cached_property
    def retention(self) -> DataFrame:
        return cohorts.cohort_retention(self.spans, self.calendar)

    @cached_property
    def churn(self) -> DataFrame:
        """Logo churn of both dimensions: dimension, segment, counts, rate."""
        return segments.logo_churn_by_dimension(
            self.tables.accounts, (self.tier, self.attribute)
        )

    @cached_property
    def by_tier(self) -> DataFrame:
        return segments.monthly_mrr_by_tier(self.spans, self.calendar)

    @cached_property
    def by_attribute(self) -> DataFrame:
        return segments.monthly_mrr_by_attribute(self.spans, self.calendar, self.attribute)

    @cached_property
    def segment_monthly(self) -> DataFrame:
        return segments.monthly_mrr_by_dimension(self.spans, self.calendar, self.tier, self.attribute)

    @cached_property
    def facts(self) -> DataFrame:
        return snapshot.monthly_facts(self.monthly)

    @cached_property
    def report(self) -> DataFrame:
        return snapshot.segment_report(self.churn)

    @cached_property
    def snapshots(self) -> DataFrame:
        return snapshot.metrics_snapshot(self.facts, self.report, self.tier, self.attribute)

    def run(self, name: str) -> DataFrame:
        """One metric by name, in its reporting order."""
        return METRICS[name](self)

    def create_views(self) -> None:
        """Offer the tables and building blocks to ``spark.sql`` as temporary views."""
        loaded = {f.name: getattr(self.tables, f.name, None) for f in fields(Tables)}
        views = {
            **{name: table for name, table in loaded.items() if table is not None},
            "subscription_timeline": subscription_timeline(self.tables.subscriptions),
            "calendar_months": self.calendar.months(self.spark),
            "account_month_mrr": panel.account_month_panel(self.spans, (self.attribute,)),
            "account_mrr_changes": panel.account_movements(self.spans),
        }
        for name, view in views.items():
            view.createOrReplaceTempView(name)
        create_functions(self.spark)

    def run_sql(self, name: str, **months: date) -> DataFrame:
        """One metric by name from its SQL over the views; first_month and last_month bound it."""
        self.create_views()
        return run_sql(self.spark, name, **months)

    def export_csv(self, folder: str) -> None:
        """All registered metrics as CSV folders named after them."""
        suite = self.with_stored_spans()
        for name in METRICS:
            write_csv(suite.run(name), f"{folder}/{name}", single_file=True)

    def export_snapshots(self, folder: str) -> None:
        write_documents(self.snapshots, folder)


# Name of each reported metric table -> how to get it.
METRICS: dict[str, Callable[[MetricSuite], DataFrame]] = {
    "mrr_waterfall": lambda s: s.waterfall.orderBy("month_start"),
    "gross_net_churn_and_nrr": lambda s: s.rates.orderBy("month_start"),
    "cohort_retention": lambda s: s.retention.orderBy("cohort_month", "months_since_signup"),
    "segment_plan_tier_churn": lambda s: _worst_first(s, s.tier),
    "segment_monthly_mrr": lambda s: s.by_tier.orderBy("month_start", s.tier),
    "segment_industry_churn": lambda s: _worst_first(s, s.attribute),
    "segment_monthly_industry_mrr": lambda s: s.by_attribute.orderBy("month_start", s.attribute),
}


def _worst_first(suite: MetricSuite, segment: str) -> DataFrame:
    churn = segments.logo_churn(suite.tables.accounts, segment)
    return churn.orderBy(churn.churn_rate_pct.desc_nulls_first(), churn[segment].asc_nulls_last())
