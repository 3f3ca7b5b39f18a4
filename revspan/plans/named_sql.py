"""The reported metrics as named SQL: table functions over the suite's views, with named parameters.

Each file in ``revspan/sql`` holds one metric as a temporary table function. The SQL is a second
statement of the metric, over the dense views; tests hold it against the operators.
"""

from __future__ import annotations

from datetime import date
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

_FOLDER = files("revspan") / "sql"
#: Helpers that the metrics share, made before them.
_SHARED = ("helpers", "monthly_flows")
SQL_METRICS = (
    "mrr_waterfall", "gross_net_churn_and_nrr", "cohort_retention", "segment_plan_tier_churn",
    "segment_monthly_mrr", "segment_industry_churn", "segment_monthly_industry_mrr",
)
_WITHOUT_MONTHS = frozenset(("segment_plan_tier_churn", "segment_industry_churn"))


def metric_sql(name: str) -> str:
    """The text of a named metric."""
    if name not in (*SQL_METRICS, *_SHARED):
        raise KeyError(name)
    return (_FOLDER / f"{name}.sql").read_text()


def create_functions(spark: SparkSession) -> None:
    """Register the metrics as temporary functions. The views they read must be there."""
    for name in (*_SHARED, *SQL_METRICS):
        spark.sql(metric_sql(name).strip().rstrip(";"))


def run_sql(
    spark: SparkSession, name: str, first_month: date = date(1000, 1, 1), last_month: date = date(9999, 12, 1)
) -> DataFrame:
    """One metric by name, for the months from first_month to last_month."""
    if name not in SQL_METRICS:
        raise KeyError(name)
    if name in _WITHOUT_MONTHS:
        return spark.sql(f"SELECT * FROM metric_{name}()")
    return spark.sql(
        f"SELECT * FROM metric_{name}(first_month => :first_month, last_month => :last_month)",
        args={"first_month": first_month, "last_month": last_month},
    )
