"""Orders and sales in the hours after a broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio, total

HOUR = 3600


def _hour(time) -> Column:
    return F.floor(F.unix_seconds(time) / HOUR)


def orders_of(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per order from order lines: ``Order_Time`` and ``GMV``, with ``keys``."""
    return lines.groupBy("Order_ID", *keys).agg(F.min("Order_Date").alias("Order_Time"), total("Net_Sales").alias("GMV"))


def effect(broadcasts: DataFrame, orders: DataFrame, hours: int = 48, keys: Sequence[str] = ()) -> DataFrame:
    """The broadcasts with ``Orders_48h``, ``GMV_48h``, ``ROI`` and ``Order_Rate`` (named by ``hours``): orders from the moment of sending, inclusive, up
    to ``hours`` later, exclusive. An order counts for every broadcast whose window it falls into, and once for each.

    Broadcasts: ``Broadcast_ID`` (unique), ``Send_Time``, ``Cost``, ``Recipients`` and, if ``keys`` name some, columns that must be equal on
    both sides, such as the channel. Orders: one row each, ``Order_Time`` and ``GMV``.

    Whole hours inside a window come from orders added up by hour, a table bounded by the calendar, however many windows overlap.
    Single orders meet only broadcasts that begin or end within their own hour.
    """
    keys = list(keys)
    begin, end = F.unix_micros("Send_Time"), F.unix_micros("Send_Time") + hours * HOUR * 1_000_000
    first, last = _hour("Send_Time"), _hour("Send_Time") + hours
    sent = broadcasts.select("Broadcast_ID", *keys, begin.alias("_begin"), end.alias("_end"), first.alias("_first"), last.alias("_last"))
    timed = orders.select(*keys, F.unix_micros("Order_Time").alias("_time"), _hour("Order_Time").alias("_hour"), "GMV").filter("_time IS NOT NULL")

    hourly = timed.groupBy(*keys, "_hour").agg(F.count("*").alias("n"), F.sum("GMV").alias("gmv"))
    inner = sent.select("Broadcast_ID", *keys, F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)).alias("_hour")) if hours > 1 else None
    edges = sent.select("Broadcast_ID", *keys, "_begin", "_end", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_hour"))
    at_edges = edges.join(timed, [*keys, "_hour"]).filter("_time >= _begin AND _time < _end")
    parts = at_edges.groupBy("Broadcast_ID").agg(F.count("*").alias("n"), F.sum("GMV").alias("gmv"))
    if inner is not None:
        parts = parts.unionByName(inner.join(hourly, [*keys, "_hour"]).select("Broadcast_ID", "n", "gmv"))
    summed = parts.groupBy("Broadcast_ID").agg(F.sum("n").alias("_n"), total("gmv").alias("_gmv"))
    n, gmv = F.coalesce("_n", F.lit(0)), F.coalesce("_gmv", F.lit(0.0))
    found = broadcasts.join(summed, "Broadcast_ID", "left").withColumns({f"Orders_{hours}h": n, f"GMV_{hours}h": gmv}).drop("_n", "_gmv")
    return found.withColumns({"ROI": ratio(f"GMV_{hours}h", "Cost"), "Order_Rate": ratio(f"Orders_{hours}h", "Recipients")})
