"""Classification of a month-over-month revenue change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The names of the movements.
NEW, CHURNED, EXPANSION, CONTRACTION, UNCHANGED = (
    "new", "churned", "expansion", "contraction", "unchanged",
)


def movement_type(prior: Column, current: Column) -> Column:
    """The two crossings of zero are tested first; the sign of the change decides the rest."""
    return (
        F.when((prior == 0) & (current > 0), NEW)
        .when((prior > 0) & (current == 0), CHURNED)
        .when(current > prior, EXPANSION)
        .when(current < prior, CONTRACTION)
        .otherwise(UNCHANGED)
    )
