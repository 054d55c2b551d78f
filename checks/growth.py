"""Attribution, broadcasts and sketches.

Touches are the events of 30 days, stretched over the years of the orders (each event day lasts 80 days); their user is
the customer's number modulo 1500. Orders get a time of day from their key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.adapters import LINES, RAW_LINES, order_lines, table
from checks.base import Check
from tradewind.operators import attribution, broadcasts, sketches

_LINES = (RAW_LINES, LINES)
_BASE, _START, _STRETCH = "2024-01-01", "1995-01-01", 80


def _stretched(column):
    base = F.unix_micros(F.lit(_BASE).cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(F.lit(_START).cast("timestamp")) + (F.unix_micros(F.col(column).cast("timestamp")) - base) * _STRETCH)


def _touches(spark, folder):
    channel = F.when(F.col("event_type") == "click", "ads").when(F.col("event_type") == "view", "video").otherwise("broadcast")
    events = table(spark, folder, "events").filter(F.col("event_type").isin("click", "view", "signup"))
    return events.select(
        F.col("user_id").alias("Customer_ID"),
        F.col("event_id").alias("Touch_ID"),
        _stretched("ts").alias("Touch_Time"),
        channel.alias("Channel"),
        F.concat(F.lit("Campaign_"), F.get_json_object("props", "$.k")).alias("Campaign_ID"),
    )


def _order_time():
    return F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 37) % 86400)


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 1500).alias("Customer_ID"),
        F.col("o_orderkey").alias("Order_ID"),
        _order_time().alias("Order_Time"),
        F.col("o_totalprice").alias("GMV"),
    )


def _credits(spark, folder):
    return attribution.credits(_touches(spark, folder), _orders(spark, folder))


def _spend(spark, folder):
    """Ad spend per month and channel: the values of the touches."""
    clicks = table(spark, folder, "events").filter(F.col("event_type") == "click")
    month = F.trunc(_stretched("ts"), "month").alias("Month")
    return clicks.groupBy(month, F.lit("ads").alias("Channel")).agg(F.sum("value").alias("Ad_Spend"))


def _contribution(spark, folder):
    return attribution.channel_contribution(_credits(spark, folder), _spend(spark, folder))


def _broadcasts(spark, folder):
    sent = table(spark, folder, "events").filter((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0))
    return sent.select(
        F.col("event_id").alias("Broadcast_ID"),
        _stretched("ts").alias("Send_Time"),
        F.when(F.col("event_id") % 2 == 0, "O").otherwise("F").alias("Target"),
        F.col("value").alias("Cost"),
        (F.lit(100) + F.col("user_id")).alias("Recipients"),
    )


def _effect(spark, folder, keys=()):
    orders = _orders(spark, folder)
    if keys:
        orders = orders.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("Order_ID"), F.col("o_orderstatus").alias("Target")), "Order_ID")
    return broadcasts.effect(_broadcasts(spark, folder), orders, keys=keys)


def _sketched(spark, folder):
    """Estimates per month and channel beside what a full count gives, and whether they are within three standard errors (distinct
    counts) and the rank error (quantiles)."""
    lines = order_lines(spark, folder, "buyer")
    month = F.trunc("Date", "month").alias("Month")
    found = sketches.merged(sketches.daily_sketches(lines), date(1996, 1, 1), date(1998, 12, 31), by=[month, "Platform"], quantiles=(0.5,))
    days = F.col("Order_Date_Only").between(F.lit(date(1996, 1, 1)), F.lit(date(1998, 12, 31)))
    keys = [F.trunc("Order_Date_Only", "month").alias("Month"), F.col("Platform")]
    values = lines.filter(days).groupBy(*keys, "Order_ID").agg(F.sum("Net_Sales").alias("Value"), F.max("Buyer_Username").alias("Buyer"))
    ranked = values.join(found.select("Month", "Platform", "Value_P50"), ["Month", "Platform"])
    exact = ranked.groupBy("Month", "Platform").agg(
        F.count("*").alias("Exact_Orders"), F.count_distinct("Buyer").alias("Exact_Buyers"), F.avg((F.col("Value") <= F.col("Value_P50")).cast("double")).alias("_rank")
    )
    near = {
        f"{n}_Near": F.abs(F.col(n) - F.col(f"Exact_{n}")) <= F.greatest(F.lit(1.0), 3 * sketches.distinct_error() * F.col(f"Exact_{n}"))
        for n in ("Orders", "Buyers")
    }
    middle = F.abs(F.col("_rank") - 0.5) <= sketches.rank_error() + 1 / F.col("Exact_Orders")
    return found.join(exact, ["Month", "Platform"]).withColumns({**near, "Median_Near": middle})


_TOUCH = f"""touch AS (
  SELECT user_id AS "Customer_ID", event_id AS "Touch_ID",
    make_timestamp(epoch_us(TIMESTAMP '{_START}') + (epoch_us(ts) - epoch_us(TIMESTAMP '{_BASE}')) * {_STRETCH}) AS "Touch_Time",
    CASE event_type WHEN 'click' THEN 'ads' WHEN 'view' THEN 'video' ELSE 'broadcast' END AS "Channel",
    'Campaign_' || json_extract_string(props, '$.k') AS "Campaign_ID", value, event_type
  FROM events WHERE event_type IN ('click', 'view', 'signup'))"""
_ORDER = """timed AS (
  SELECT o_custkey % 1500 AS "Customer_ID", o_orderkey AS "Order_ID", o_orderstatus AS "Target",
    o_orderdate + to_seconds((o_orderkey * 37) % 86400) AS "Order_Time", o_totalprice AS "GMV" FROM orders)"""
_CREDIT = """found AS (
  SELECT timed.*, "Touch_ID", "Touch_Time", "Channel", "Campaign_ID", count("Touch_ID") OVER (PARTITION BY "Order_ID") AS "Touches",
    row_number() OVER (PARTITION BY "Order_ID" ORDER BY "Touch_Time", "Touch_ID") AS "Position",
    pow(0.5, (epoch_us("Order_Time") - epoch_us("Touch_Time")) / 86400000000 / 7) AS weight
  FROM timed LEFT JOIN touch ON timed."Customer_ID" = touch."Customer_ID" AND "Touch_Time" <= "Order_Time"
    AND "Touch_Time" >= "Order_Time" - INTERVAL 30 DAY),
credit AS (
  SELECT * EXCLUDE ("Channel"), coalesce("Channel", 'organic') AS "Channel",
    CASE WHEN "Touches" = 0 THEN NULL WHEN "Touches" = 1 THEN 'only' WHEN "Position" = 1 THEN 'first'
         WHEN "Position" = "Touches" THEN 'last' ELSE 'assist' END AS "Touchpoint_Position",
    CASE WHEN "Position" = 1 THEN 1.0 ELSE 0 END AS "First_Touch", CASE WHEN "Touches" = 0 OR "Position" = "Touches" THEN 1.0 ELSE 0 END AS "Last_Touch",
    CASE WHEN "Touches" = 0 THEN 1.0 ELSE CAST(1 AS DOUBLE) / "Touches" END AS "Linear",
    CASE WHEN "Touches" = 0 THEN 1.0 ELSE weight / sum(weight) OVER (PARTITION BY "Order_ID") END AS "Time_Decay"
  FROM found)"""
_ATTRIBUTION = (_TOUCH, _ORDER, _CREDIT)
_MODELS = ("First_Touch", "Last_Touch", "Linear", "Time_Decay")
_SENT = """sent AS (
  SELECT "Touch_ID" AS "Broadcast_ID", "Touch_Time" AS "Send_Time", CASE WHEN "Touch_ID" % 2 = 0 THEN 'O' ELSE 'F' END AS "Target",
    value AS "Cost", 100 + "Customer_ID" AS "Recipients"
  FROM touch WHERE event_type = 'signup' AND "Touch_ID" % 7 = 0)"""


def _effect_sql(same: str) -> str:
    return f"""SELECT "Broadcast_ID", "Send_Time", "Orders_48h", "GMV_48h", CASE WHEN "Cost" > 0 THEN "GMV_48h" / "Cost" ELSE 0 END AS "ROI",
      "Orders_48h" / "Recipients" AS "Order_Rate"
    FROM (SELECT "Broadcast_ID", "Send_Time", "Cost", "Recipients", count("Order_ID") AS "Orders_48h", coalesce(sum(CAST("GMV" AS DECIMAL(18,4))), 0) AS "GMV_48h"
      FROM sent LEFT JOIN timed ON "Order_Time" >= "Send_Time" AND "Order_Time" < "Send_Time" + INTERVAL 48 HOUR {same}
      GROUP BY ALL)"""


_CONTRIBUTION = f"""SELECT month AS "Month", c."Channel", "Orders_Touched", {", ".join(f'"{m}_Orders", "{m}_GMV", CASE WHEN "Ad_Spend" > 0 THEN "{m}_GMV" / "Ad_Spend" ELSE 0 END AS "{m}_ROAS"' for m in _MODELS)}
  FROM (SELECT date_trunc('month', "Order_Time") AS month, "Channel", count(DISTINCT "Order_ID") AS "Orders_Touched",
      {", ".join(f'sum("{m}") AS "{m}_Orders", sum("{m}" * "GMV") AS "{m}_GMV"' for m in _MODELS)} FROM credit GROUP BY ALL) AS c
    LEFT JOIN (SELECT date_trunc('month', "Touch_Time") AS month, 'ads' AS "Channel", sum(value) AS "Ad_Spend" FROM touch WHERE event_type = 'click' GROUP BY ALL) USING (month, "Channel")"""
_SKETCHED = """SELECT date_trunc('month', "Order_Date_Only") AS "Month", "Platform", count(DISTINCT "Order_ID") AS "Exact_Orders",
  count(DISTINCT "Buyer_Username") AS "Exact_Buyers", sum("Net_Sales") AS "GMV", true AS "Orders_Near", true AS "Buyers_Near", true AS "Median_Near"
  FROM lines WHERE "Order_Date_Only" BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL"""

CHECKS = [
    Check(
        "attribution",
        "Order_ID:l Touch_ID:l Touch_Time:t Channel:s Campaign_ID:s Touches:l Position:i Touchpoint_Position:s First_Touch:f6 Last_Touch:f6 Linear:f6 Time_Decay:f6 GMV:f2",
        _credits,
        "SELECT * FROM credit",
        _ATTRIBUTION,
    ),
    Check(
        "attribution_by_channel",
        "Month:d Channel:s Orders_Touched:l " + " ".join(f"{m}_Orders:f2 {m}_GMV:f1 {m}_ROAS:f1" for m in _MODELS),
        _contribution,
        _CONTRIBUTION,
        _ATTRIBUTION,
    ),
    Check(
        "attribution_transitions",
        "Channel:s Next_Channel:s Steps:l Orders:l",
        lambda spark, folder: attribution.touch_transitions(_credits(spark, folder)),
        """SELECT "Channel", "Next_Channel", count(*) AS "Steps", count(DISTINCT "Order_ID") AS "Orders"
           FROM (SELECT "Channel", "Order_ID", coalesce(lead("Channel") OVER (PARTITION BY "Order_ID" ORDER BY "Position"), 'order') AS "Next_Channel" FROM credit)
           GROUP BY ALL""",
        _ATTRIBUTION,
    ),
    Check("broadcast_effect", "Broadcast_ID:l Send_Time:t Orders_48h:l GMV_48h:f2 ROI:f2 Order_Rate:f4", _effect, _effect_sql(""), (_TOUCH, _ORDER, _SENT)),
    Check(
        "broadcast_effect_target",
        "Broadcast_ID:l Send_Time:t Orders_48h:l GMV_48h:f2 ROI:f2 Order_Rate:f4",
        lambda spark, folder: _effect(spark, folder, ("Target",)),
        _effect_sql('AND sent."Target" = timed."Target"'),
        (_TOUCH, _ORDER, _SENT),
    ),
    Check(
        "sketches",
        "Month:d Platform:s Exact_Orders:l Exact_Buyers:l GMV:f2 Orders_Near:b Buyers_Near:b Median_Near:b",
        _sketched,
        _SKETCHED,
        _LINES,
    ),
]
