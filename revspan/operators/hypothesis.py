"""Significance of segment differences in logo churn, for many dimensions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revspan.functions.chi2 import chi2_p_value
from revspan.functions.money import percent

# Fixed value: the significance level used unless the caller gives another.
ALPHA = 0.05

_SUMS = ("k", "total", "churned", "sum_x2_over_n", "sum_n2")
_COUNTS = ("n_a", "x_a", "n_b", "x_b")


def contingency(churn: DataFrame) -> DataFrame:
    """Churned and not churned accounts per segment."""
    return churn.select(
        "dimension", "segment", "n_churned",
        (F.col("n_accounts") - F.col("n_churned")).alias("n_not_churned"),
    )


def chi_square_sums() -> list[Column]:
    """Aggregates over one dimension's segments that determine its k x 2 test."""
    n = F.col("n_accounts").cast("double")
    x = F.col("n_churned").cast("double")
    return [
        F.count("*").alias("k"),
        F.sum("n_accounts").cast("double").alias("total"),
        F.sum("n_churned").cast("double").alias("churned"),
        F.sum(x * x / n).alias("sum_x2_over_n"),
        F.sum(n * n).alias("sum_n2"),
    ]


def with_chi_square(sums: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add the struct ``chi_square`` (chi2, dof, p_value, significant) from ``chi_square_sums``.

    With a pooled rate p, the k x 2 statistic is sum((x - n p)^2 / (n p (1 - p))), which
    needs no second pass over the segments. Two segments get the continuity correction
    (at most half an account off each deviation, which is the same in all four cells).
    If nobody or everybody churned there is no test: NULL.
    """
    total, churned, k = F.col("total"), F.col("churned"), F.col("k")
    rate = churned / F.nullif(total, F.lit(0.0))
    plain = (F.col("sum_x2_over_n") - churned * churned / total) / F.col("spread")
    # In a 2 x 2 table: statistic = deviation^2 * total^3 / (n1 n2 c1 c2).
    per_deviation = total / ((total * total - F.col("sum_n2")) / 2 * F.col("spread"))
    kept = F.greatest(F.sqrt(F.col("plain") / F.col("per_deviation")) - 0.5, F.lit(0.0))
    statistic = (
        F.when(k == 1, F.col("plain") * 0.0)
        .when(k == 2, F.pow(kept, F.lit(2.0)) * F.col("per_deviation"))
        .otherwise(F.col("plain"))
    )
    # One step per column: each is used several times in the next.
    steps = (
        sums
        .withColumn("spread", F.nullif(rate * (1 - rate), F.lit(0.0)))
        .withColumns({
            "plain": F.greatest(plain, F.when(F.col("spread").isNotNull(), 0.0)),
            "per_deviation": F.when(k == 2, per_deviation),
        })
        .withColumn("statistic", statistic)
        .withColumn("dof", F.when(F.col("statistic").isNotNull(), (k - 1).cast("int")))
        .withColumn("p", chi2_p_value("statistic", "dof"))
    )
    test = F.struct(
        F.round("statistic", 3).alias("chi2"), "dof", F.round("p", 4).alias("p_value"),
        (F.col("p") < alpha).alias("significant"),
    )
    return steps.withColumn("chi_square", test).select(
        *[c for c in sums.columns if c not in _SUMS], "chi_square"
    )


def chi_square_by_dimension(churn: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Does churn differ between the segments of each dimension?"""
    sums = churn.groupBy("dimension").agg(*chi_square_sums())
    return with_chi_square(sums, alpha).select("dimension", "chi_square.*")


def with_z_test(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Turn the counts n_a, x_a, n_b, x_b into churn_pct_a, churn_pct_b, z, p_value and
    significant: a pooled two-proportion test, NULL if a side is missing or the error is 0.

    The two-sided normal tail of z is the chi-square tail of z^2 with one degree.
    """
    n1, x1, n2, x2 = (F.col(c).cast("double") for c in _COUNTS)
    pooled = F.col("pooled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return (
        pairs
        .withColumn("pooled", (x1 + x2) / (n1 + n2))
        .withColumn("z", (x1 / n1 - x2 / n2) / F.nullif(error, F.lit(0.0)))
        .withColumn("squared", F.col("z") * F.col("z"))
        .withColumn("p", chi2_p_value("squared", 1))
        .select(
            *[c for c in pairs.columns if c not in _COUNTS],
            percent(F.col("x_a"), F.col("n_a"), 1).alias("churn_pct_a"),
            percent(F.col("x_b"), F.col("n_b"), 1).alias("churn_pct_b"),
            F.round("z", 3).alias("z"),
            F.round("p", 4).alias("p_value"),
            (F.col("p") < alpha).alias("significant"),
        )
    )


def z_test_pairs(churn: DataFrame, pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One test per row of ``pairs`` (dimension, segment_a, segment_b)."""
    def side(name: str) -> DataFrame:
        return churn.select(
            F.col("dimension").alias(f"dimension_{name}"),
            F.col("segment").alias(f"value_{name}"),
            F.col("n_accounts").alias(f"n_{name}"),
            F.col("n_churned").alias(f"x_{name}"),
        )

    def matches(name: str) -> Column:
        return (F.col("dimension") == F.col(f"dimension_{name}")) & F.col(
            f"segment_{name}"
        ).eqNullSafe(F.col(f"value_{name}"))

    joined = pairs.join(side("a"), matches("a"), "left").join(side("b"), matches("b"), "left")
    return with_z_test(joined.select("dimension", "segment_a", "segment_b", *_COUNTS), alpha)


def segment_extremes(churn: DataFrame) -> DataFrame:
    """Highest and lowest churn rate of each dimension; equal rates rank by segment name."""
    return churn.groupBy("dimension").agg(*extreme_sums()).select(
        "dimension",
        F.col("highest.segment").alias("highest_segment"),
        F.col("highest.churn_rate_pct").alias("highest_rate_pct"),
        F.col("lowest.segment").alias("lowest_segment"),
        F.col("lowest.churn_rate_pct").alias("lowest_rate_pct"),
    )


def extreme_sums() -> list[Column]:
    facts = F.struct("segment", "n_accounts", "n_churned", "churn_rate_pct")
    rank = F.struct("churn_rate_pct", "segment")
    return [F.max_by(facts, rank).alias("highest"), F.min_by(facts, rank).alias("lowest")]


def extreme_pairs(churn: DataFrame) -> DataFrame:
    """The default pair of each dimension: its worst against its best segment."""
    return segment_extremes(churn).select(
        "dimension",
        F.col("highest_segment").alias("segment_a"),
        F.col("lowest_segment").alias("segment_b"),
    )
