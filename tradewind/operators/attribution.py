"""Credit of an order to the touches that came before it: first, last, linear, time decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio, total

MODELS = ("First_Touch", "Last_Touch", "Linear", "Time_Decay")
ORGANIC = "organic"


def touches_before(touches: DataFrame, orders: DataFrame, look_back_days: int = 30) -> DataFrame:
    """Every order with each touch of its customer in the ``look_back_days`` before it, the moment of the order included.

    Touches: ``Customer_ID``, ``Touch_ID``, ``Touch_Time``, ``Channel``, ``Campaign_ID``. Orders, one row each: ``Customer_ID``,
    ``Order_ID``, ``Order_Time``, ``GMV``, and what else is to be kept. Orders without a touch keep one row, with the channel
    ``organic``.

    Both sides meet by customer and by time, in buckets as long as the look-back: an order looks into its own bucket and the one before.
    So the touches of a busy customer are spread over as many keys as they have buckets, and no pair further apart than two
    buckets is ever formed.
    """
    seconds = look_back_days * 86_400
    bucket = (F.unix_seconds("Touch_Time") / seconds).cast("bigint")
    left = touches.filter("Customer_ID IS NOT NULL AND Touch_Time IS NOT NULL").select(
        F.col("Customer_ID").alias("_customer"), bucket.alias("_bucket"), "Touch_ID", "Touch_Time", "Channel", "Campaign_ID"
    )
    own = (F.unix_seconds("Order_Time") / seconds).cast("bigint")
    # The row of the order's own bucket stays when there is no touch at all.
    right = orders.withColumn("_own", own).withColumn("_at", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    near = F.col("Touch_Time").between(F.col("Order_Time") - F.make_interval(days=F.lit(look_back_days)), F.col("Order_Time"))
    joined = right.join(left, (F.col("Customer_ID") == F.col("_customer")) & (F.col("_at") == F.col("_bucket")) & near, "left")
    found = F.count("Touch_Time").over(Window.partitionBy("Order_ID"))
    kept = joined.withColumn("Touches", found).filter((F.col("Touch_Time").isNotNull()) | ((F.col("Touches") == 0) & (F.col("_at") == F.col("_own"))))
    return kept.withColumn("Channel", F.coalesce("Channel", F.when(F.col("Touches") == 0, ORGANIC))).drop("_customer", "_bucket", "_own", "_at")


def credits(touches: DataFrame, orders: DataFrame, look_back_days: int = 30, half_life_days: float = 7.0) -> DataFrame:
    """One row per order and touch, with the credit that each model gives it; the credits of an order sum to 1.

    Time decay halves the weight with every ``half_life_days`` between touch and order. Touches of the same moment are
    ordered by id. ``Touchpoint_Position`` is first, last, assist or, for a single one, only; none for organic orders."""
    by_order = Window.partitionBy("Order_ID")
    in_time = by_order.orderBy("Touch_Time", "Touch_ID")
    age_days = (F.unix_micros("Order_Time") - F.unix_micros("Touch_Time")) / 86_400_000_000
    rows = touches_before(touches, orders, look_back_days).withColumns(
        {
            "Position": F.row_number().over(in_time),
            "_weight": F.when(F.col("Touches") == 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life_days)),
        }
    )
    alone, first, last = F.col("Touches") <= 1, F.col("Position") == 1, F.col("Position") == F.col("Touches")
    position = (
        F.when(F.col("Touches") == 0, F.lit(None))
        .when(alone, "only").when(first, "first").when(last, "last").otherwise("assist")
    )
    return rows.withColumns(
        {
            "Touchpoint_Position": position,
            "First_Touch": first.cast("double"),
            "Last_Touch": (last | alone).cast("double"),
            "Linear": 1 / F.greatest("Touches", F.lit(1)),
            "Time_Decay": F.col("_weight") / F.sum("_weight").over(by_order),
        }
    ).drop("_weight")


def channel_contribution(credited: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """Orders and GMV that each model credits to a channel, by month; with ``spend`` (``Month``, ``Channel``, ``Ad_Spend``) the
    blended ROAS of each model as well."""
    month = F.trunc("Order_Time", "month").alias("Month")
    sums = [F.round(F.sum(m), 4).alias(f"{m}_Orders") for m in MODELS]
    sums += [total(F.col(m) * F.col("GMV")).alias(f"{m}_GMV") for m in MODELS]
    result = credited.groupBy(month, "Channel").agg(F.count_distinct("Order_ID").alias("Orders_Touched"), *sums)
    if spend is None:
        return result
    joined = result.join(spend, ["Month", "Channel"], "left")
    return joined.withColumns({f"{m}_ROAS": ratio(f"{m}_GMV", F.coalesce("Ad_Spend", F.lit(0.0))) for m in MODELS})


def touch_transitions(credited: DataFrame) -> DataFrame:
    """How often a channel was followed by another on the way to an order; the last touch is followed by ``order``."""
    in_time = Window.partitionBy("Order_ID").orderBy("Position")
    after = F.coalesce(F.lead("Channel").over(in_time), F.lit("order"))
    return credited.withColumn("Next_Channel", after).groupBy("Channel", "Next_Channel").agg(
        F.count("*").alias("Steps"), F.count_distinct("Order_ID").alias("Orders")
    )
