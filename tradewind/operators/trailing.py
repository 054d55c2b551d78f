"""Daily figures against the calendar days before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio_or_null


def every_day(daily: DataFrame, figures: Sequence[str], keys: Sequence[str] = ("Platform",), day: str = "Date") -> DataFrame:
    """Each key with all calendar days from its first to its last, figures of absent days 0.

    The days come from one row per key, so the calendar is never crossed with the data."""
    span = daily.groupBy(*keys).agg(F.sequence(F.min(day), F.max(day)).alias("_days"))
    days = span.select(*keys, F.explode("_days").alias(day))
    joined = days.join(daily.select(*keys, day, *figures), [*keys, day], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in figures})


def against_trailing_mean(daily: DataFrame, figures: Sequence[str], keys: Sequence[str] = ("Platform",), days: int = 7, day: str = "Date") -> DataFrame:
    """``daily`` without gaps, with the mean of each figure over the ``days`` calendar days before (the day itself not included) and the
    change against it; no mean on the first day, no change where the mean is 0.

    The frame is a range of days, so it is right whatever days are absent."""
    before = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    filled = every_day(daily, figures, keys, day)
    means = {f"{c}_Mean{days}": F.avg(c).over(before) for c in figures}
    return filled.withColumns(means).withColumns({f"{c}_Change": ratio_or_null(c, f"{c}_Mean{days}") - 1 for c in figures})


def roas_alerts(daily: DataFrame, keys: Sequence[str] = ("Platform",), days: int = 7, drop: float = 0.2) -> DataFrame:
    """Daily ROAS (``Sales`` over ``Ad_Cost``) against that of the ``days`` days before, taken as one (sums over sums, so a day
    with little spend weighs little), and whether it fell by more than ``drop``."""
    before = Window.partitionBy(*keys).orderBy(F.unix_date("Date")).rangeBetween(-days, -1)
    filled = every_day(daily, ["Sales", "Ad_Cost"], keys)
    usual = ratio_or_null(F.sum("Sales").over(before), F.sum("Ad_Cost").over(before))
    rows = filled.withColumns({"ROAS": ratio_or_null("Sales", "Ad_Cost"), "Usual_ROAS": usual})
    change = ratio_or_null("ROAS", "Usual_ROAS") - 1
    return rows.withColumn("ROAS_Change", change).withColumn("Alert", F.coalesce(F.col("ROAS_Change") < -drop, F.lit(False)))
