"""Upper tail of the chi-square distribution as a column expression.

Spark SQL has no error or gamma function. For whole degrees of freedom the tail is a finite
sum; odd degrees add the complementary error function, summed from its power series.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# erfc(sqrt(h)), h = x / 2. From h = 40 on it is below 1e-18; up to there 200 terms of the
# series reach double precision.
_ERFC = """
CASE WHEN {x} > 80 THEN 0D ELSE greatest(0D, 1 - aggregate(
  sequence(1, 200),
  named_struct('term', 2 * sqrt({x} / 2 / pi()) * exp(-{x} / 2),
               'total', 2 * sqrt({x} / 2 / pi()) * exp(-{x} / 2)),
  (acc, i) -> named_struct('term', acc.term * {x} / 2 / (i + 0.5D),
                           'total', acc.total + acc.term * {x} / 2 / (i + 0.5D)),
  acc -> acc.total)) END
"""

# h^(i + o) e^-h / gamma(i + o + 1) for i = 0 .. k div 2 - 1, with o = 1/2 for odd k, else 0.
# The terms are carried as logarithms, so that many degrees of freedom do not underflow.
_FIRST = "(if({k} % 2 = 1, ln(2 * sqrt({x} / 2 / pi())), 0D) - {x} / 2)"
_STEP = "(acc.log_term + ln({x} / 2) - ln(i + if({k} % 2 = 1, 0.5D, 0D)))"
_SERIES = f"""
CASE WHEN {{k}} < 2 THEN 0D ELSE aggregate(
  if({{k}} < 4, array(), sequence(1, CAST({{k}} DIV 2 AS INT) - 1)),
  named_struct('log_term', {_FIRST}, 'total', exp({_FIRST})),
  (acc, i) -> named_struct('log_term', {_STEP}, 'total', acc.total + exp({_STEP})),
  acc -> acc.total) END
"""

_TAIL = f"""
CASE WHEN {{x}} IS NULL OR {{k}} IS NULL THEN NULL
     WHEN {{x}} <= 0 OR {{k}} = 0 THEN 1D
     ELSE least(1D, {_SERIES} + if({{k}} % 2 = 1, {_ERFC}, 0D)) END
"""


def chi2_p_value(statistic: str, dof: str | int) -> Column:
    """P(X > statistic), for a DOUBLE column and an INT column or number, by name."""
    return F.expr(_TAIL.format(x=statistic, k=dof))
