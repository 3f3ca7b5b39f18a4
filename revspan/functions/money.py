"""Exact arithmetic for money, rates and their text forms.

Dividing two wide decimals makes Spark cut the quotient to six places, and rounding that again
is wrong by a cent now and then. Rates and means are therefore rounded in whole numbers:
the whole quotient of 2 * n * scale + d and 2 * d on cents, which needs no narrowing and gives the same in any
session setting.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"
_WHOLE = "decimal(38,0)"


def no_money() -> Column:
    return F.lit(0).cast(MONEY)


def _cents(amount: Column) -> Column:
    return (amount.cast("decimal(38,2)") * F.lit(100)).cast(_WHOLE)


def rounded_ratio(numerator: Column, denominator: Column, factor: int, places: int) -> Column:
    """numerator * factor / denominator, rounded half up to decimals; NULL for a zero denominator."""
    n, d = _cents(numerator), _cents(denominator)
    size = F.abs(n) * F.lit(2 * factor * 10**places).cast("decimal(18,0)") + F.abs(d)
    size, unit = size.cast(_WHOLE), F.nullif((F.abs(d) * F.lit(2)).cast(_WHOLE), F.lit(0).cast(_WHOLE))
    whole = ((size - size % unit) / unit).cast("decimal(29,0)")  # `div` would wrap around at 2^63
    return F.when((n < 0) != (d < 0), -whole).otherwise(whole) * F.lit(Decimal(1).scaleb(-places))


def percent(numerator: Column, denominator: Column, places: int) -> Column:
    return rounded_ratio(numerator, denominator, 100, places)


def mean_amount(total: Column, count: Column) -> Column:
    """Average in cents, half up; NULL for an empty group."""
    return rounded_ratio(total, count, 1, 2)


def whole_dollars(amount: Column) -> Column:
    """``$1,234`` and ``$-1,234``; rounded half up before it becomes text."""
    return F.concat(F.lit("$"), F.format_number(F.round(amount, 0), 0))


def plain_number(value: Column) -> Column:
    """Shortest decimal text, as ``5.0``, ``17.58`` or ``0.0003``; four places at most, never an exponent."""
    return F.regexp_replace(value.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def percent_label(pct: Column) -> Column:
    return F.concat(F.round(pct, 1).cast("decimal(38,1)").cast("string"), F.lit("%"))
