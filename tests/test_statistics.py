"""Significance tests: published figures, Spark ML as a second opinion, degenerate tables."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from revspan.functions.chi2 import chi2_p_value
from revspan.operators import hypothesis as h, segments


def churn(spark, *rows):
    """(dimension, segment, accounts, churned)"""
    df = spark.createDataFrame(
        rows, "dimension string, segment string, n_accounts bigint, n_churned bigint"
    )
    return df.withColumn(
        "churn_rate_pct", F.round(F.lit(100) * F.col("n_churned") / F.col("n_accounts"), 1)
        .cast("decimal(5,1)")
    )


TIERS = [("tier", "Enterprise", 154, 34), ("tier", "Basic", 168, 37), ("tier", "Pro", 178, 39)]
FIELDS = [("field", "Dev", 113, 35), ("field", "Sec", 100, 16)]


def test_three_segments(spark):
    r = h.chi_square_by_dimension(churn(spark, *TIERS)).first()
    assert (r.chi2, r.dof, r.p_value, r.significant) == (0.001, 2, 0.9993, False)


def test_two_proportions(spark):
    df = churn(spark, *FIELDS)
    pairs = spark.createDataFrame(
        [("field", "Dev", "Sec"), ("field", "Dev", "Nobody")],
        "dimension string, segment_a string, segment_b string",
    )
    rows = {r.segment_b: r for r in h.z_test_pairs(df, pairs).collect()}
    r = rows["Sec"]
    assert (r.z, r.p_value, r.significant) == (2.556, 0.0106, True)
    assert (float(r.churn_pct_a), float(r.churn_pct_b)) == (31.0, 16.0)
    assert rows["Nobody"].z is None and rows["Nobody"].p_value is None


def test_two_segments_are_corrected_for_continuity(spark):
    r = h.chi_square_by_dimension(churn(spark, *FIELDS)).first()
    total, x = 213, 51
    stat = 0.0
    for n, seen in ((113, 35), (100, 16)):
        for observed, share in ((seen, x / total), (n - seen, 1 - x / total)):
            expected = n * share
            gap = abs(observed - expected)
            stat += (gap - min(0.5, gap)) ** 2 / expected
    assert r.dof == 1 and r.chi2 == pytest.approx(stat, abs=5e-4)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(stat / 2)), abs=5e-5)


@pytest.mark.parametrize("churned", [0, 1])
def test_nobody_or_everybody_churned(spark, churned):
    df = churn(spark, ("d", "a", 10, 10 * churned), ("d", "b", 20, 20 * churned), ("d", "c", 5, 5 * churned))
    r = h.chi_square_by_dimension(df).first()
    assert (r.chi2, r.dof, r.p_value, r.significant) == (None, None, None, None)
    pair = spark.createDataFrame([("d", "a", "b")], "dimension string, segment_a string, segment_b string")
    assert h.z_test_pairs(df, pair).first().z is None


def test_a_single_segment(spark):
    r = h.chi_square_by_dimension(churn(spark, ("d", "a", 10, 4))).first()
    assert (r.chi2, r.dof, r.p_value) == (0.0, 0, 1.0)


def test_agrees_with_spark_ml(spark):
    rows = [("d", "a", 120, 30), ("d", "b", 80, 31), ("d", "c", 60, 9), ("d", "e", 200, 61)]
    mine = h.chi_square_by_dimension(churn(spark, *rows)).first()
    points = [(Vectors.dense(float(i)), float(label))
              for i, (_, _, n, x) in enumerate(rows) for label in [1] * x + [0] * (n - x)]
    theirs = ChiSquareTest.test(
        spark.createDataFrame(points, ["features", "label"]), "features", "label", True
    ).first()
    assert mine.chi2 == pytest.approx(theirs.statistic, abs=5e-4)
    assert mine.dof == theirs.degreesOfFreedom
    assert mine.p_value == pytest.approx(theirs.pValue, abs=5e-5)


def test_tail_over_a_wide_range(spark):
    cases = [(x, k) for x in (1e-9, 0.5, 3.84, 20.0, 79.0, 81.0, 2000.0) for k in (1, 2, 3, 8, 101, 2000)]
    df = spark.createDataFrame(cases, "x double, k int").select("x", "k", chi2_p_value("x", "k").alias("p"))
    for r in df.collect():
        half, o = r.x / 2, 0.5 * (r.k % 2)
        exact = (math.erfc(math.sqrt(half)) if r.k % 2 else 0.0) + math.fsum(
            math.exp((i + o) * math.log(half) - half - math.lgamma(i + o + 1)) for i in range(r.k // 2))
        assert r.p == pytest.approx(min(exact, 1.0), abs=1e-10)


def test_extremes_break_ties_by_name(spark):
    df = churn(spark, ("d", "a", 10, 5), ("d", "b", 10, 5), ("d", "y", 10, 1), ("d", "z", 10, 1))
    r = h.segment_extremes(df).first()
    assert (r.highest_segment, r.lowest_segment) == ("b", "y")


def test_null_flags_and_null_segments(spark):
    accounts = spark.createDataFrame(
        [("A", True), ("A", None), (None, False), (None, True)], "plan_tier string, churn_flag boolean"
    )
    rows = {r.plan_tier: r for r in segments.logo_churn(accounts, "plan_tier").collect()}
    assert (rows["A"].n_accounts, rows["A"].n_churned) == (2, 1)
    assert float(rows[None].churn_rate_pct) == 50.0
