"""Range and segment exploration, answered for a whole table of requests at once.

A request is a row (request_id, dimension, segment, start_month, end_month). The dimension
``all`` asks for the whole business and has a NULL segment. Requests are laid out over the
months they ask for, at most the calendar's, and meet the stored metrics in equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revspan.functions.calendar import Calendar, months_from_to
from revspan.functions.growth import MIN_GROWTH_BASE, growth_label, guarded_growth_pct

WHOLE_BUSINESS = "all"
REQUEST = ["request_id", "dimension", "segment", "start_month", "end_month"]


def month_domain(monthly: DataFrame) -> DataFrame:
    """The months a range filter offers, as text. ``monthly`` is any table of the months: a
    stored metric, or the calendar, which spares computing one."""
    return monthly.select(F.date_format("month_start", "yyyy-MM").alias("month")).distinct()


def in_range(table: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """Rows of the inclusive month range; prunes a table stored by month."""
    def month(bound: Column | str) -> Column:
        return F.lit(bound).cast("date") if isinstance(bound, str) else bound

    return table.where(F.col("month_start").between(month(start), month(end)))


def segment_in_range(
    table: DataFrame, segment_column: str, value: str, start: Column | str, end: Column | str
) -> DataFrame:
    return in_range(table.where(F.col(segment_column) == value), start, end)


def _requested_months(requests: DataFrame, calendar: Calendar) -> DataFrame:
    """request x month, cut to the calendar; a request outside it keeps one NULL month."""
    first = F.greatest("start_month", calendar.first)
    last = F.least("end_month", calendar.last)
    months = F.when(first <= last, months_from_to(F.least(first, last), last))
    return requests.select(*REQUEST, F.explode_outer(months).alias("month_start"))


def range_kpis(requests: DataFrame, monthly: DataFrame, calendar: Calendar,
               min_base: float = MIN_GROWTH_BASE) -> DataFrame:
    """Whole-business tiles: growth is measured from what the first month started with."""
    asked = requests.where(F.col("dimension") == WHOLE_BUSINESS)
    month = F.col("month_start")
    kpis = (
        _requested_months(asked, calendar)
        .join(monthly, "month_start", "left")
        .groupBy(*REQUEST)
        .agg(
            F.max_by("ending_mrr", month).alias("ending_mrr"),
            F.min_by("starting_mrr", month).alias("range_start_mrr"),
            F.round(F.avg("gross_mrr_churn_rate_pct"), 1).alias("avg_gross_churn_pct"),
            F.round(F.avg("net_mrr_churn_rate_pct"), 1).alias("avg_net_churn_pct"),
        )
    )
    return _with_growth(kpis, min_base)


def segment_range_kpis(
    requests: DataFrame, segment_monthly: DataFrame, churn: DataFrame, monthly: DataFrame,
    calendar: Calendar, min_base: float = MIN_GROWTH_BASE,
) -> DataFrame:
    """Segment tiles: first and last available month of the segment in the range (0 if it
    has none), lifetime logo churn, and the whole business's mean NRR for context."""
    asked = requests.where(F.col("dimension") != WHOLE_BUSINESS)
    available = F.when(F.col("total_mrr").isNotNull(), F.col("month_start"))
    kpis = (
        _requested_months(asked, calendar)
        .join(segment_monthly, ["dimension", "segment", "month_start"], "left")
        .join(monthly.select("month_start", "nrr_pct"), "month_start", "left")
        .groupBy(*REQUEST)
        .agg(
            F.coalesce(F.max_by("total_mrr", available), F.lit(0)).alias("ending_mrr"),
            F.coalesce(F.min_by("total_mrr", available), F.lit(0)).alias("range_start_mrr"),
            F.round(F.avg("nrr_pct"), 1).alias("business_avg_nrr_pct"),
        )
        .join(
            churn.select("dimension", "segment", F.col("churn_rate_pct").alias("logo_churn_pct")),
            ["dimension", "segment"], "left",
        )
    )
    return _with_growth(kpis, min_base)


def segment_kpis_from_store(
    requests: DataFrame, stored_segments: DataFrame, churn: DataFrame, monthly: DataFrame,
    calendar: Calendar, min_base: float = MIN_GROWTH_BASE,
) -> DataFrame:
    """The segment tiles from a store that is partitioned by month (``write_by_month``): same columns and values.

    ``requests`` is a stored table, small enough to be broadcast. It meets the store in an inner join on the
    month, so its months become a filter on the store's partitions when the query runs: what
    is read follows the request, not the store.
    """
    asked = requests.where(F.col("dimension") != WHOLE_BUSINESS)
    months = _requested_months(asked, calendar).select("request_id", "dimension", "segment", "month_start")
    month = F.col("month_start")
    of_segment = months.join(stored_segments, ["month_start", "dimension", "segment"]).groupBy("request_id").agg(
        F.max_by("total_mrr", month).alias("last_mrr"), F.min_by("total_mrr", month).alias("first_mrr"))
    of_business = months.join(monthly.select("month_start", "nrr_pct"), "month_start").groupBy("request_id").agg(
        F.round(F.avg("nrr_pct"), 1).alias("business_avg_nrr_pct"))
    kpis = (
        asked.join(of_segment, "request_id", "left").join(of_business, "request_id", "left")
        .join(churn.select("dimension", "segment", F.col("churn_rate_pct").alias("logo_churn_pct")),
              ["dimension", "segment"], "left")
        .select(
            *REQUEST, F.coalesce("last_mrr", F.lit(0)).alias("ending_mrr"),
            F.coalesce("first_mrr", F.lit(0)).alias("range_start_mrr"), "business_avg_nrr_pct", "logo_churn_pct",
        )
    )
    return _with_growth(kpis, min_base)


def _with_growth(kpis: DataFrame, min_base: float) -> DataFrame:
    growth = guarded_growth_pct(F.col("range_start_mrr"), F.col("ending_mrr"), min_base)
    return kpis.withColumn("growth_pct", growth).withColumn(
        "growth_label", growth_label(F.col("growth_pct"))
    )


def trend_series(requests: DataFrame, segment_monthly: DataFrame, monthly: DataFrame,
                 calendar: Calendar) -> DataFrame:
    """The revenue line of every request: total for the whole business (active_accounts
    NULL), total and active accounts for a segment. Months without data have no point."""
    asked = _requested_months(requests, calendar)
    whole = asked.where(F.col("dimension") == WHOLE_BUSINESS).join(
        monthly.select("month_start", F.col("ending_mrr").alias("mrr")), "month_start"
    ).withColumn("active_accounts", F.lit(None).cast("bigint"))
    by_segment = asked.where(F.col("dimension") != WHOLE_BUSINESS).join(
        segment_monthly.withColumnRenamed("total_mrr", "mrr"),
        ["dimension", "segment", "month_start"],
    )
    columns = ["request_id", "dimension", "segment", "month_start", "mrr", "active_accounts"]
    return whole.select(*columns).unionByName(by_segment.select(*columns))


def yearly_requests(churn: DataFrame, calendar: Calendar) -> DataFrame:
    """A request table covering everything: the whole business and every segment, for each
    calendar year and for the whole calendar."""
    years = F.transform(
        F.sequence(F.trunc("first_month", "YEAR"), F.col("last_month"), F.expr("interval 1 year")),
        lambda y: F.struct(
            F.greatest(y, F.col("first_month")).alias("start_month"),
            F.least(F.add_months(y, 11), F.col("last_month")).alias("end_month"),
        ),
    )
    whole = F.array(F.struct(
        F.col("first_month").alias("start_month"), F.col("last_month").alias("end_month")
    ))
    segments = churn.where(F.col("segment").isNotNull()).select("dimension", "segment")
    business = churn.sparkSession.range(1).select(
        F.lit(WHOLE_BUSINESS).alias("dimension"), F.lit(None).cast("string").alias("segment")
    )
    return (
        segments.unionByName(business)
        .withColumns({"first_month": calendar.first, "last_month": calendar.last})
        .select("dimension", "segment", F.inline(F.array_distinct(F.concat(years, whole))))
        .select(
            F.concat_ws(
                "|", "dimension", F.coalesce("segment", F.lit("*")),
                F.col("start_month").cast("string"), F.col("end_month").cast("string"),
            ).alias("request_id"),
            "dimension", "segment", "start_month", "end_month",
        )
    )
