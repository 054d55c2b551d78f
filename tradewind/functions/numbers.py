"""Guarded ratios, shares and bucket labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator, denominator, otherwise=0.0) -> Column:
    """``numerator / denominator`` as double where the denominator is positive, else ``otherwise``."""
    top, bottom = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def ratio_or_null(numerator, denominator) -> Column:
    """``numerator / nullif(denominator, 0)`` as double."""
    return as_column(numerator).cast("double") / F.nullif(
        as_column(denominator).cast("double"), F.lit(0.0)
    )


def total(column) -> Column:
    """Sum of a column, 0 for none, rounded to the 4 decimals money has.

    The order in which tasks add doubles changes the last digits of a sum; rounding removes that, so a
    repeated or resumed run gives the same totals. Decimal columns are summed as decimals.
    """
    return F.round(F.coalesce(F.sum(column), F.lit(0)), 4)


def growth(current, previous) -> Column:
    """Relative change as a fraction; null when there is no previous value or it is zero."""
    return ratio_or_null(current, previous) - F.lit(1.0)


def change_pct(current, previous) -> Column:
    """Change in percent, ``(current - previous) / previous * 100``; null when previous is zero."""
    current, previous = as_column(current), as_column(previous)
    return ratio_or_null(current - previous, previous) * 100


def first_match(rules: Sequence[tuple[Column, object]], otherwise) -> Column:
    """Label of the first rule that holds, as one ``CASE WHEN`` chain."""
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def score_above(value, edges: Sequence, lowest: int = 1) -> Column:
    """``lowest`` plus the number of edges the value exceeds (right-closed bins)."""
    score = F.lit(lowest)
    for edge in edges:
        score = score + (as_column(value) > F.lit(edge)).cast("int")
    return score


def whole_table() -> WindowSpec:
    """Window over all rows, in one task.

    Only for tables whose size is bounded by the calendar, the channels, the provinces or the segments;
    tables that grow with customers or products use staged totals instead.
    """
    return Window.partitionBy()
