"""Spans and waterfall stored, and audited while they are written: no scan is made for the audits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from revspan.functions.calendar import month_index_gap
from revspan.operators.audits import broken_identity, broken_nrr
from revspan.operators.waterfall import with_rates
from revspan.plans.suite import MetricSuite, Tables
from revspan.sources.shared import stored

_RESULT = "audit string, subject string, n_checked long, n_breaks long, first_day date, last_day date"


def _profile(day: str, required: tuple[str, ...]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col(day).cast("date")).alias("first_day"),
        F.max(F.col(day).cast("date")).alias("last_day"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    ]


def store_with_audits(suite: MetricSuite) -> tuple[MetricSuite, DataFrame]:
    """The suite with stored spans, and the audits that its two writes have gathered on the way.

    Rows: audit, subject, n_checked, n_breaks, first_day, last_day. ``not_null`` and ``coverage`` look at the
    accounts and subscriptions as they are scanned for the spans, ``completeness`` at the spans (account-months
    against accounts times months), ``identity``, ``continuity`` and ``nrr`` at the waterfall. Duplicate
    primary keys need a grouping of their own: ``audits.constraint_profile``.
    """
    spark, pinned = suite.spark, suite.calendar.resolve(suite.spark)
    checked = {
        "accounts": ("signup_date", ("account_id", "signup_date")),
        "subscriptions": ("start_date", ("subscription_id", "account_id", "start_date")),
    }
    seen = {name: Observation() for name in (*checked, "spans", "waterfall")}
    tables = Tables(*[
        getattr(suite.tables, name).observe(seen[name], *_profile(*rules)) for name, rules in checked.items()
    ])
    watched = replace(suite, tables=tables, calendar=pinned, stored_spans=None)
    cells = F.when(F.col("is_known") & (F.col("from_month") <= F.col("to_month")),
                   month_index_gap(F.col("to_month"), F.col("from_month")) + 1).otherwise(0)
    spans = stored(watched.spans.observe(seen["spans"], F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("n_cells")), "spans")
    audited = replace(suite, calendar=pinned, stored_spans=spans)

    following = F.lead("starting_mrr").over(Window.orderBy("month_start"))  # one row per calendar month
    stored(
        with_rates(audited.waterfall).withColumn("next_starting_mrr", following).observe(
            seen["waterfall"], F.count(F.lit(1)).alias("n_months"), F.count_if(broken_identity()).alias("identity"),
            F.count("next_starting_mrr").alias("n_pairs"),
            F.count_if(F.col("ending_mrr") != F.col("next_starting_mrr")).alias("continuity"),
            F.count("nrr_pct").alias("n_measured"), F.count_if(broken_nrr()).alias("nrr")),
        "waterfall")

    rows = []
    for name, (_, required) in checked.items():
        got = seen[name].get
        rows.append(("coverage", name, got["n_rows"], None, got["first_day"], got["last_day"]))
        rows += [("not_null", f"{name}.{c}", got["n_rows"], got[f"null_{c}"], None, None) for c in required]
    months, n_cells = seen["waterfall"].get, seen["spans"].get["n_cells"]
    missing = seen["accounts"].get["n_rows"] * months["n_months"] - n_cells
    rows += [
        ("completeness", "account_month_mrr", n_cells, missing, None, None),
        ("identity", "mrr_waterfall", months["n_months"], months["identity"], None, None),
        ("continuity", "mrr_waterfall", months["n_pairs"], months["continuity"], None, None),
        ("nrr", "mrr_waterfall", months["n_measured"], months["nrr"], None, None),
    ]
    return audited, spark.createDataFrame(rows, _RESULT)
