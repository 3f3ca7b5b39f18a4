"""Facts as of every month, the nested snapshot document and its fact sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revspan.functions.money import percent, plain_number, whole_dollars
from revspan.operators.hypothesis import (
    ALPHA, chi_square_sums, extreme_sums, with_chi_square, with_z_test,
)

PERIOD_MEANS = {
    "avg_gross_churn_pct_full_period": "gross_mrr_churn_rate_pct",
    "avg_net_churn_pct_full_period": "net_mrr_churn_rate_pct",
    "avg_nrr_pct_full_period": "nrr_pct",
}


def period_mean_rates(monthly: DataFrame) -> DataFrame:
    """Unweighted means of the rounded monthly rates, unmeasurable months left out."""
    return monthly.agg(
        *[F.round(F.avg(rate), 1).alias(name) for name, rate in PERIOD_MEANS.items()]
    )


def monthly_facts(monthly: DataFrame) -> DataFrame:
    """Every as-of month with the month before it and the mean rates up to it.

    ``monthly`` is the waterfall with its rates: one row per calendar month, which is all
    this window ever orders.
    """
    by_month = Window.orderBy("month_start")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.col("ending_mrr") - F.col("prior_month_ending_mrr")
    return (
        monthly
        .select(
            "*",
            F.lag("ending_mrr").over(by_month).alias("prior_month_ending_mrr"),
            F.count("*").over(so_far).alias("n_months"),
            *[
                F.round(F.avg(rate).over(so_far), 1).alias(name)
                for name, rate in PERIOD_MEANS.items()
            ],
        )
        .withColumn("mrr_change_dollars", change)
        .withColumn(
            "mom_mrr_growth_pct",
            percent(F.col("mrr_change_dollars"), F.col("prior_month_ending_mrr"), 2),
        )
    )


def latest_facts(facts: DataFrame) -> DataFrame:
    """The last as-of month."""
    return facts.orderBy(F.col("month_start").desc()).limit(1)


def segment_report(churn: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per dimension: its segments as nested records (worst first), the extremes,
    the test over all segments and the test of worst against best.

    A dimension's records hold one entry per distinct segment value.
    """
    ordered = F.array_sort(F.collect_list(F.struct(
        (-F.col("churn_rate_pct")).alias("order_key"),
        "segment", "n_accounts", "n_churned", "churn_rate_pct",
    )))
    grouped = churn.groupBy("dimension").agg(
        ordered.alias("ordered"), *extreme_sums(), *chi_square_sums()
    )
    records = F.transform("ordered", lambda r: F.struct(
        r.segment.alias("segment"), r.n_accounts.alias("n_accounts"),
        r.n_churned.alias("n_churned"), r.churn_rate_pct.alias("churn_rate_pct"),
    ))
    tested = with_z_test(with_chi_square(grouped, alpha).select(
        "dimension", records.alias("records"), "highest", "lowest", "chi_square",
        F.col("highest.segment").alias("segment_a"), F.col("lowest.segment").alias("segment_b"),
        F.col("highest.n_accounts").alias("n_a"), F.col("highest.n_churned").alias("x_a"),
        F.col("lowest.n_accounts").alias("n_b"), F.col("lowest.n_churned").alias("x_b"),
    ), alpha)
    ztest = F.struct(
        "segment_a", "segment_b", "churn_pct_a", "churn_pct_b", "z", "p_value", "significant"
    )
    return tested.select(
        "dimension", "records", "highest", "lowest", "chi_square", ztest.alias("ztest")
    )


def _reports(report: DataFrame) -> Column:
    """The report of every dimension as one map value (a scalar subquery, no join)."""
    entry = F.struct("dimension", F.struct("records", "highest", "lowest", "chi_square", "ztest"))
    return report.agg(F.map_from_entries(F.collect_list(entry)).alias("r")).scalar()


def metrics_snapshot(
    facts: DataFrame, report: DataFrame, tier: str = "plan_tier", industry: str = "industry"
) -> DataFrame:
    """The snapshot document as of every month, one nested row each.

    Segment churn and its tests look at lifetime flags, so they are the same in every row.
    """
    of_tier, of_industry = F.col("reports")[tier], F.col("reports")[industry]
    return (
        facts.withColumn("reports", _reports(report))
        .select(
            F.col("month_start").alias("latest_month"),
            "ending_mrr", "prior_month_ending_mrr", "mrr_change_dollars", "mom_mrr_growth_pct",
            "new_mrr", "expansion_mrr", "contraction_mrr", "churned_mrr",
            "gross_mrr_churn_rate_pct", "net_mrr_churn_rate_pct", "nrr_pct",
            *PERIOD_MEANS,
            of_tier.records.alias("plan_tier_churn"),
            of_industry.records.alias("industry_churn"),
            F.struct(
                of_tier.chi_square.alias("plan_tier_chi_square"),
                of_industry.ztest.alias("industry_churn_ztest"),
            ).alias("hypothesis_tests"),
        )
    )


def fact_sheet(facts: DataFrame, report: DataFrame,
               tier: str = "plan_tier", industry: str = "industry") -> DataFrame:
    """The snapshot as sentences: source_month, fact_id, fact.

    Every comparison is settled here, so that whoever writes prose from it computes nothing.
    """
    return numbered_facts(facts, report, tier, industry).drop("position")


def summary_documents(numbered: DataFrame, generator: str) -> DataFrame:
    """One document per month: source_month, generator, generated_at, lines (fact_id, fact; in the sheet's
    order) and the summary text of one line each. A month has as many lines as the sheet has facts."""
    line = F.struct("position", "fact_id", "fact")
    ordered = numbered.groupBy("source_month").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return ordered.select(
        "source_month", F.lit(generator).alias("generator"), F.current_timestamp().alias("generated_at"),
        F.transform("lines", lambda x: F.struct(x.fact_id.alias("fact_id"), x.fact.alias("fact"))).alias("lines"),
        F.array_join(F.transform("lines", lambda x: F.coalesce(x.fact, F.lit(""))), "\n").alias("summary"),
    )


def numbered_facts(facts: DataFrame, report: DataFrame,
                   tier: str = "plan_tier", industry: str = "industry") -> DataFrame:
    """The fact sheet with each line's place in it: source_month, position (from 0), fact_id, fact."""
    reports = F.col("reports")

    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("n/a"))

    def dollars(name: str) -> Column:
        return shown(whole_dollars(F.col(name)))

    def pct(value: Column) -> Column:
        return shown(F.concat(plain_number(value), F.lit("%")))

    def extreme(dimension: str, which: str) -> Column:
        row = reports[dimension][which]
        return F.concat(shown(row.segment), F.lit(" at "), pct(row.churn_rate_pct))

    def listing(dimension: str) -> Column:
        return F.array_join(F.transform(reports[dimension].records, lambda r: F.concat(
            shown(r.segment), F.lit(" "), pct(r.churn_rate_pct), F.lit(" ("),
            r.n_churned.cast("string"), F.lit(" of "), r.n_accounts.cast("string"), F.lit(")"),
        )), ", ")

    def verdict(test: Column) -> Column:
        return F.concat(
            F.lit("p = "), shown(plain_number(test.p_value)), F.lit(" ("),
            F.when(test.significant, "statistically significant")
            .when(~test.significant, "NOT statistically significant")
            .otherwise("not testable"), F.lit(")"),
        )

    chi_square, ztest = reports[tier].chi_square, reports[industry].ztest
    # The labels and their order.
    facts_in_order: Sequence[tuple[str, list[Column | str]]] = [
        ("latest_month", ["Latest month: ", F.col("month_start").cast("string")]),
        ("ending_mrr", ["Ending MRR: ", dollars("ending_mrr")]),
        ("prior_ending_mrr", ["Prior month ending MRR: ", dollars("prior_month_ending_mrr")]),
        ("mrr_change", ["Dollar change vs prior month: ", dollars("mrr_change_dollars")]),
        ("mom_growth", ["Month-over-month MRR growth: ", pct(F.col("mom_mrr_growth_pct"))]),
        ("movements", [
            "New MRR: ", dollars("new_mrr"), ", Expansion: ", dollars("expansion_mrr"),
            ", Contraction: ", dollars("contraction_mrr"), ", Churned: ", dollars("churned_mrr"),
        ]),
        ("gross_churn", ["Gross MRR churn rate: ", pct(F.col("gross_mrr_churn_rate_pct"))]),
        ("net_churn", ["Net MRR churn rate: ", pct(F.col("net_mrr_churn_rate_pct"))]),
        ("nrr", ["NRR: ", pct(F.col("nrr_pct"))]),
        ("period_average", [
            "Full ", F.col("n_months").cast("string"), "-month average: gross churn ",
            pct(F.col("avg_gross_churn_pct_full_period")), ", net churn ",
            pct(F.col("avg_net_churn_pct_full_period")), ", NRR ",
            pct(F.col("avg_nrr_pct_full_period")),
        ]),
        ("tier_churn", ["Churn by plan tier: ", listing(tier)]),
        ("tier_highest", ["Highest-churn plan tier: ", extreme(tier, "highest")]),
        ("tier_lowest", ["Lowest-churn plan tier: ", extreme(tier, "lowest")]),
        ("tier_test", [
            "Plan tier chi-square test: ", verdict(chi_square),
            F.when(chi_square.significant, "; the tiers differ")
            .when(~chi_square.significant, "; the tiers are essentially tied").otherwise(""),
        ]),
        ("industry_churn", ["Churn by industry: ", listing(industry)]),
        ("industry_highest", ["Highest-churn industry: ", extreme(industry, "highest")]),
        ("industry_lowest", ["Lowest-churn industry: ", extreme(industry, "lowest")]),
        ("industry_test", [
            shown(ztest.segment_a), " vs ", shown(ztest.segment_b),
            " two-proportion z-test: ", verdict(ztest),
        ]),
    ]
    lines = F.array(*[
        F.struct(
            F.lit(position).alias("position"),
            F.lit(fact_id).alias("fact_id"),
            F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("fact"),
        )
        for position, (fact_id, parts) in enumerate(facts_in_order)
    ])
    return facts.withColumn("reports", _reports(report)).select(
        F.col("month_start").alias("source_month"), F.inline(lines)
    )


def with_provenance(sheet: DataFrame, generator: str) -> DataFrame:
    """Stamp each fact with when and by what it was made."""
    return sheet.withColumns({
        "generated_at": F.current_timestamp(), "generator": F.lit(generator),
    })
