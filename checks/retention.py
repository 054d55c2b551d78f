"""Cohorts, churn, lifetime value, segment migration, trailing means and repurchase."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.adapters import LINES, RAW_LINES, order_lines, table
from checks.base import Check
from checks.customers import _RULES
from tradewind.operators import masters, repurchase, retention, trailing

_LINES = (RAW_LINES, LINES)
_BEFORE, _AFTER, _CUT = date(1999, 12, 1), date(2000, 1, 1), date(2000, 1, 1)


def _purchases(spark, folder):
    return retention.with_cohort(retention.monthly_purchases(order_lines(spark, folder, "buyer")))


def _spend(spark, folder):
    """Two percent of the sales of a month's first ten days."""
    lines = order_lines(spark, folder).filter(F.dayofmonth("Order_Date_Only") <= 10)
    return lines.groupBy(F.trunc("Order_Date_Only", "month").alias("Month")).agg((F.sum("Net_Sales") * 0.02).alias("Ad_Spend"))


def _ltv(spark, folder):
    return retention.ltv_to_cac(retention.cohort_triangle(_purchases(spark, folder)), _spend(spark, folder))


def _migration(spark, folder):
    return retention.segment_migration(retention.segment_moves(order_lines(spark, folder, "buyer"), _BEFORE, _AFTER))


def _trailing(spark, folder):
    """Every third day is taken out, so that there are gaps."""
    daily = masters.daily_totals(order_lines(spark, folder)).filter(F.dayofyear("Date") % 3 != 0)
    return trailing.against_trailing_mean(daily, ["GMV", "Orders"])


def _alerts(spark, folder):
    events = table(spark, folder, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "marketplace").otherwise("social")
    daily = events.groupBy(F.to_date("ts").alias("Date"), kind.alias("Platform")).agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0)).alias("Sales"),
        F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0)).alias("Ad_Cost"),
    )
    return trailing.roas_alerts(daily.filter(F.dayofmonth("Date") % 4 != 0))


def _features(spark, folder):
    return repurchase.labelled(repurchase.orders_of(order_lines(spark, folder, "buyer", "product")), _CUT)


_PURCHASES = """purchases AS (
  SELECT "Buyer_Username" AS "Customer_ID", date_trunc('month', "Order_Date_Only") AS "Month", count(DISTINCT "Order_ID") AS "Orders",
    sum("Net_Sales") AS "GMV", sum("True_Net_Revenue") AS "Net_Revenue", min(date_trunc('month', "Order_Date_Only")) AS m
  FROM lines WHERE "Buyer_Username" <> '' GROUP BY 1, 2),
cohorts AS (SELECT *, min("Month") OVER (PARTITION BY "Customer_ID") AS "Cohort" FROM purchases),
triangle AS (
  SELECT "Cohort", date_diff('month', "Cohort", "Month") AS "Age", count(*) AS "Customers", sum("Orders") AS "Orders", sum("GMV") AS "GMV",
    sum("Net_Revenue") AS "Net_Revenue"
  FROM cohorts GROUP BY 1, 2),
sized AS (
  SELECT t.*, s.n AS "Cohort_Size", "Customers" / s.n AS "Retention",
    CAST((SELECT sum(u."GMV") FROM triangle u WHERE u."Cohort" = t."Cohort" AND u."Age" <= t."Age") AS DOUBLE) / s.n AS "GMV_To_Date",
    CAST((SELECT sum(u."Net_Revenue") FROM triangle u WHERE u."Cohort" = t."Cohort" AND u."Age" <= t."Age") AS DOUBLE) / s.n AS "Net_Revenue_To_Date"
  FROM triangle t JOIN (SELECT "Cohort", count(DISTINCT "Customer_ID") AS n FROM cohorts GROUP BY 1) s USING ("Cohort"))"""
_COHORT = (*_LINES, _PURCHASES)


def _segments_at(day: date) -> str:
    """Customers and their segment as of a day, from the lines before it."""
    return f"""SELECT "Customer_ID", CASE {_RULES}
        WHEN R_Score + F_Score + M_Score >= 13 THEN 'Loyal Customers' WHEN R_Score + F_Score + M_Score >= 10 THEN 'Potential Loyalist'
        WHEN R_Score + F_Score + M_Score >= 7 THEN 'Need Attention' WHEN R_Score + F_Score + M_Score >= 4 THEN 'At Risk' ELSE 'Lost' END AS "Segment"
      FROM (SELECT b.*,
          CASE WHEN "Recency" <= q[1] THEN 5 WHEN "Recency" <= q[2] THEN 4 WHEN "Recency" <= q[3] THEN 3 WHEN "Recency" <= q[4] THEN 2 ELSE 1 END AS "R_Score",
          greatest(1, ((row_number() OVER (ORDER BY "Frequency", "Customer_ID") - 1) * 5 + n - 2) // (n - 1)) AS "F_Score",
          greatest(1, ((row_number() OVER (ORDER BY "Monetary", "Customer_ID") - 1) * 5 + n - 2) // (n - 1)) AS "M_Score"
        FROM base_{day:%m} b, (SELECT quantile_cont("Recency", [0.2, 0.4, 0.6, 0.8]) AS q, count(*) AS n FROM base_{day:%m}))"""


def _base_at(day: date) -> str:
    return f"""base_{day:%m} AS (
  SELECT "Buyer_Username" AS "Customer_ID", date_diff('day', max("Order_Date"), TIMESTAMP '{day}') AS "Recency",
    count(DISTINCT "Order_ID") AS "Frequency", sum("Net_Sales") AS "Monetary"
  FROM lines WHERE "Buyer_Username" <> '' AND "Order_Date" < TIMESTAMP '{day}' GROUP BY 1)"""


_TRAILING = """SELECT "Date", "Platform", "GMV", "Orders",
    avg("GMV") OVER w AS "GMV_Mean7", "GMV" / nullif(avg("GMV") OVER w, 0) - 1 AS "GMV_Change",
    avg("Orders") OVER w AS "Orders_Mean7", "Orders" / nullif(avg("Orders") OVER w, 0) - 1 AS "Orders_Change"
  FROM (SELECT days."Platform", days."Date", coalesce(CAST(d."GMV" AS DOUBLE), 0) AS "GMV", coalesce(d."Orders", 0) AS "Orders"
    FROM (SELECT "Platform", CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM kept GROUP BY 1) AS days
      LEFT JOIN kept AS d USING ("Platform", "Date"))
  WINDOW w AS (PARTITION BY "Platform" ORDER BY "Date" RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
_KEPT = """kept AS (
  SELECT "Order_Date_Only" AS "Date", "Platform", sum("Net_Sales") AS "GMV", count(DISTINCT "Order_ID") AS "Orders"
  FROM lines WHERE dayofyear("Order_Date_Only") % 3 <> 0 GROUP BY 1, 2)"""
_ALERTS = """SELECT *, "ROAS" / nullif("Usual_ROAS", 0) - 1 AS "ROAS_Change", coalesce("ROAS" / nullif("Usual_ROAS", 0) - 1 < -0.2, false) AS "Alert"
  FROM (SELECT "Date", "Platform", "Sales" / nullif("Ad_Cost", 0) AS "ROAS", sum("Sales") OVER w / nullif(sum("Ad_Cost") OVER w, 0) AS "Usual_ROAS"
    FROM (SELECT days."Platform", days."Date", coalesce("Sales", 0) AS "Sales", coalesce("Ad_Cost", 0) AS "Ad_Cost"
      FROM (SELECT "Platform", CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM spent GROUP BY 1) AS days
        LEFT JOIN spent USING ("Platform", "Date"))
    WINDOW w AS (PARTITION BY "Platform" ORDER BY "Date" RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
_SPENT = """spent AS (
  SELECT CAST(ts AS DATE) AS "Date", CASE WHEN user_id % 2 = 0 THEN 'marketplace' ELSE 'social' END AS "Platform",
    sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS "Sales", sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS "Ad_Cost"
  FROM events WHERE dayofmonth(CAST(ts AS DATE)) % 4 <> 0 GROUP BY 1, 2)"""
_FEATURES = f"""SELECT p."Customer_ID", date_diff('day', max("Order_Date"), TIMESTAMP '{_CUT}') AS "Recency", count(*) AS "Frequency", sum("GMV") AS "Monetary",
    sum("GMV") / count(*) AS "Average_Order_Value",
    CASE WHEN count(*) > 1 THEN date_diff('day', min("Order_Date"), max("Order_Date")) / (count(*) - 1) ELSE 0 END AS "Days_Between_Orders",
    arg_max("Category", ("Order_Date", "Order_ID")) AS "Category", CAST(max(b."Customer_ID") IS NOT NULL AS INTEGER) AS "Repurchase"
  FROM bought p LEFT JOIN (SELECT DISTINCT "Customer_ID" FROM bought WHERE "Order_Date" >= TIMESTAMP '{_CUT}' AND "Order_Date" < TIMESTAMP '{_CUT}' + INTERVAL 30 DAY) b USING ("Customer_ID")
  WHERE "Order_Date" < TIMESTAMP '{_CUT}' GROUP BY 1"""
_BOUGHT = """bought AS (
  SELECT "Customer_ID", "Order_ID", min(d) AS "Order_Date", CAST(sum(g) AS DOUBLE) AS "GMV", arg_min("SKU", (-g, "SKU")) AS "Category"
  FROM (SELECT "Buyer_Username" AS "Customer_ID", "Order_ID", "SKU", min("Order_Date") AS d, sum("Net_Sales") AS g FROM lines GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

CHECKS = [
    Check(
        "new_and_returning",
        "Month:d Kind:s Customers:l Orders:l GMV:f2",
        lambda spark, folder: retention.new_and_returning(_purchases(spark, folder)),
        """SELECT "Month", CASE WHEN "Month" = "Cohort" THEN 'new' ELSE 'returning' END AS "Kind", count(*) AS "Customers", sum("Orders") AS "Orders",
             sum("GMV") AS "GMV" FROM cohorts GROUP BY 1, 2""",
        _COHORT,
    ),
    Check(
        "cohort_triangle",
        "Cohort:d Age:i Customers:l Orders:l GMV:f2 Cohort_Size:l Retention:f6 GMV_To_Date:f2",
        lambda spark, folder: retention.cohort_triangle(_purchases(spark, folder)),
        "SELECT * FROM sized",
        _COHORT,
    ),
    Check(
        "churn",
        "Month:d Active:l Churned:l Churn_Rate:f6",
        lambda spark, folder: retention.churn(_purchases(spark, folder), within=2),
        """SELECT p."Month", count(*) AS "Active", count(*) FILTER (NOT EXISTS (SELECT 1 FROM purchases q WHERE q."Customer_ID" = p."Customer_ID"
             AND q."Month" > p."Month" AND q."Month" <= p."Month" + INTERVAL 2 MONTH)) AS "Churned", "Churned" / "Active" AS "Churn_Rate"
           FROM purchases p WHERE "Month" + INTERVAL 2 MONTH <= (SELECT max("Month") FROM purchases) GROUP BY 1""",
        _COHORT,
    ),
    Check(
        "ltv_to_cac",
        "Cohort:d New_Customers:l LTV:f2 CAC:f2 LTV_CAC:f2",
        _ltv,
        """SELECT "Cohort", n AS "New_Customers", "LTV", coalesce(spend, 0) / n AS "CAC", CASE WHEN spend > 0 THEN "LTV" / (spend / n) END AS "LTV_CAC"
           FROM (SELECT "Cohort", max("Cohort_Size") AS n, arg_max("Net_Revenue_To_Date", "Age") AS "LTV" FROM sized GROUP BY 1)
             LEFT JOIN (SELECT date_trunc('month', "Order_Date_Only") AS "Cohort", CAST(sum("Net_Sales") AS DOUBLE) * 0.02 AS spend
                        FROM lines WHERE dayofmonth("Order_Date_Only") <= 10 GROUP BY 1) USING ("Cohort")""",
        _COHORT,
    ),
    Check(
        "segment_migration",
        "Segment_Before:s Segment_After:s Customers:l Share:f6",
        _migration,
        f"""SELECT "Segment_Before", "Segment_After", count(*) AS "Customers", count(*) / sum(count(*)) OVER (PARTITION BY "Segment_Before") AS "Share"
            FROM (SELECT coalesce(a."Segment", 'none') AS "Segment_Before", coalesce(b."Segment", 'none') AS "Segment_After"
                  FROM ({_segments_at(_BEFORE)}) AS a FULL JOIN ({_segments_at(_AFTER)}) AS b USING ("Customer_ID")) GROUP BY 1, 2""",
        (*_LINES, _base_at(_BEFORE), _base_at(_AFTER)),
    ),
    Check(
        "trailing_mean",
        "Date:d Platform:s GMV:f2 Orders:l GMV_Mean7:f2 GMV_Change:f4 Orders_Mean7:f4 Orders_Change:f4",
        _trailing,
        _TRAILING,
        (*_LINES, _KEPT),
    ),
    Check("roas_alerts", "Date:d Platform:s ROAS:f4 Usual_ROAS:f4 ROAS_Change:f4 Alert:b", _alerts, _ALERTS, (_SPENT,)),
    Check(
        "repurchase_features",
        "Customer_ID:s Recency:l Frequency:l Monetary:f2 Average_Order_Value:f2 Days_Between_Orders:f4 Category:s Repurchase:i",
        _features,
        _FEATURES,
        (*_LINES, _BOUGHT),
    ),
    Check(
        "days_to_next_order",
        "Customer_ID:s Order_ID:l Days_To_Next_Order:l Repurchase_30d:b",
        lambda spark, folder: repurchase.days_to_next_order(repurchase.orders_of(order_lines(spark, folder, "buyer", "product"))),
        """SELECT *, coalesce("Days_To_Next_Order" <= 30, false) AS "Repurchase_30d" FROM (
             SELECT "Customer_ID", "Order_ID", date_diff('day', "Order_Date", lead("Order_Date") OVER (PARTITION BY "Customer_ID" ORDER BY "Order_Date", "Order_ID")) AS "Days_To_Next_Order"
             FROM bought)""",
        (*_LINES, _BOUGHT),
    ),
]
