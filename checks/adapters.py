"""The benchmark tables in the shape of the commerce data, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.functions.numbers import total
from tradewind.operators.channels import keep_statuses, with_totals
from tradewind.operators.promotion import clean_ads, engagement_rate

VALID = ("F", "O")
KEYWORD = "ring"
MONEY = "decimal(18,4)"  # only for the few values that are written as text


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A benchmark table; its schema is read from the files once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def order_lines(spark: SparkSession, folder: str, *needs: str, valid: bool = True) -> DataFrame:
    """Order lines; ``needs`` says which of product, buyer and province are joined.

    Orders are completed with the buyer first and lines with the product, so the last and largest join is
    on the order key, by which distinct orders are counted afterwards. What is computed of a line is computed after
    the joins, for which only the stored columns are shuffled.
    """
    lines = table(spark, folder, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    columns = [
        F.col("l_orderkey").alias("Order_ID"),
        F.col("l_linenumber").alias("Line"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("Line_Key"),
        F.col("l_quantity").alias("Quantity"),
        (price * (1 - discount)).alias("Net_Sales"),
        (price * discount).alias("Seller_Discount"),
        F.lit(0.0).alias("Platform_Discount"),
        (price * F.col("l_tax")).alias("Commission"),
        (price * 0.02).alias("Transaction_Fee"),
        F.lit(0.0).alias("Service_Fee"),
    ]
    if "product" in needs:
        part = table(spark, folder, "part")
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"])
        columns += [
            F.col("p_name").alias("Product_Name"),
            F.col("p_brand").alias("SKU"),
            F.col("p_retailprice").alias("Original_Price"),
        ]

    orders = table(spark, folder, "orders")
    if valid:
        orders = keep_statuses(orders.withColumnRenamed("o_orderstatus", "Order_Status"), VALID)
    else:
        orders = orders.withColumnRenamed("o_orderstatus", "Order_Status")
    priority = F.col("o_orderpriority")
    of_order = [
        "o_orderkey",
        "Order_Status",
        F.col("o_orderdate").alias("Order_Date"),
        F.to_date("o_orderdate").alias("Order_Date_Only"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "marketplace")
        .when(priority == "5-LOW", "direct")
        .otherwise("social")
        .alias("Platform"),
    ]
    if "buyer" in needs or "province" in needs:
        customer = table(spark, folder, "customer")
        if "province" in needs:
            nation = table(spark, folder, "nation")
            customer = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
            of_order.append(F.col("n_name").alias("Province"))
        orders = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        of_order.append(F.col("c_name").alias("Buyer_Username"))
    orders = orders.select(*of_order)
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return with_totals(joined.select(*columns, *[c for c in orders.columns if c != "o_orderkey"]))


ALL = ("product", "buyer", "province")

RAW_LINES = """raw_lines AS (
  SELECT o_orderkey AS "Order_ID", l_linenumber AS "Line", o_orderstatus AS "Order_Status",
    o_orderdate AS "Order_Date", CAST(o_orderdate AS DATE) AS "Order_Date_Only",
    p_name AS "Product_Name", p_brand AS "SKU", n_name AS "Province", c_name AS "Buyer_Username",
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'marketplace'
         WHEN o_orderpriority = '5-LOW' THEN 'direct' ELSE 'social' END AS "Platform",
    CAST(l_quantity AS DECIMAL(18,4)) AS "Quantity",
    CAST(p_retailprice AS DECIMAL(18,4)) AS "Original_Price",
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS "Net_Sales",
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS "Total_Discount",
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS "Commission",
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS "Transaction_Fee",
    CAST(0 AS DECIMAL(18,4)) AS "Service_Fee",
    CAST("Commission" + "Transaction_Fee" AS DECIMAL(18,4)) AS "Total_Fees",
    CAST("Net_Sales" - "Total_Fees" AS DECIMAL(18,4)) AS "True_Net_Revenue"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
LINES = """lines AS (SELECT * FROM raw_lines WHERE "Order_Status" IN ('F', 'O'))"""
DAILY = """daily_totals AS (
  SELECT "Order_Date_Only" AS "Date", "Platform", count(DISTINCT "Order_ID") AS "Orders", sum("Net_Sales") AS "GMV",
    sum("True_Net_Revenue") AS "Net_Revenue", sum("Quantity") AS "Units_Sold", sum("Total_Fees") AS "Total_Fees",
    sum("Total_Discount") AS "Total_Discount", sum("Commission") AS "Commission",
    sum("Transaction_Fee") AS "Transaction_Fee", sum("Service_Fee") AS "Service_Fee",
    CAST(sum("Net_Sales") AS DOUBLE) / count(DISTINCT "Order_ID") AS "AOV"
  FROM lines GROUP BY 1, 2),
daily_sales AS (
  SELECT *,
    CAST("GMV" AS DOUBLE) / nullif(CAST(lag("GMV", 1) OVER w AS DOUBLE), 0) - 1 AS "DoD_GMV_Growth",
    CAST("GMV" AS DOUBLE) / nullif(CAST(lag("GMV", 7) OVER w AS DOUBLE), 0) - 1 AS "WoW_GMV_Growth",
    CAST("GMV" AS DOUBLE) / nullif(CAST(lag("GMV", 30) OVER w AS DOUBLE), 0) - 1 AS "MoM_GMV_Growth",
    CAST("GMV" AS DOUBLE) / nullif(CAST(lag("GMV", 90) OVER w AS DOUBLE), 0) - 1 AS "QoQ_GMV_Growth",
    CASE WHEN CAST("GMV" AS DOUBLE) >= (SELECT quantile_cont(CAST("GMV" AS DOUBLE), 0.8) FROM daily_totals) THEN 'Max (Top 20%)'
         WHEN CAST("GMV" AS DOUBLE) <= (SELECT quantile_cont(CAST("GMV" AS DOUBLE), 0.2) FROM daily_totals) THEN 'Min (Bottom 20%)'
         ELSE 'Middle' END AS "GMV_Segment",
    CASE WHEN "AOV" > 1.2 * (SELECT avg("AOV") FROM daily_totals) THEN 'Max (>20% Avg)'
         WHEN "AOV" < 0.8 * (SELECT avg("AOV") FROM daily_totals) THEN 'Min (<-20% Avg)'
         ELSE 'Middle' END AS "AOV_Segment"
  FROM daily_totals WINDOW w AS (PARTITION BY "Platform" ORDER BY "Date"))"""
PRODUCTS = """product_totals AS (
  SELECT "Product_Name", "SKU", "Platform", count(DISTINCT "Order_ID") AS "Orders", sum("Net_Sales") AS "Total_GMV",
    sum("True_Net_Revenue") AS "Net_Revenue", sum("Quantity") AS "Total_Qty", sum("Total_Discount") AS "Total_Discount",
    CAST(sum("Net_Sales") AS DOUBLE) / CAST(sum("Quantity") AS DOUBLE) AS "Avg_Price",
    CAST(sum("Net_Sales") AS DOUBLE) AS g, CAST(sum("Quantity") AS DOUBLE) AS q
  FROM lines GROUP BY 1, 2, 3),
product_limits AS (SELECT quantile_cont(g, 0.5) AS mg, quantile_cont(q, 0.5) AS mq, CAST(sum("Total_GMV") AS DOUBLE) AS total FROM product_totals),
product_segments AS (
  SELECT product_totals.*,
    CASE WHEN g > mg AND q > mq THEN 'Star (High GMV, High Volume)' WHEN g > mg THEN 'Hero (High GMV)'
         WHEN q > mq THEN 'Volume (High Volume, Low GMV)' ELSE 'Core (Average)' END AS "Product_Segment",
    round_even(g / total * 100, 2) AS "GMV_Contribution_Pct"
  FROM product_totals, product_limits),
products AS (
  SELECT *, CASE WHEN "Product_Segment" LIKE 'Hero%' AND "GMV_Contribution_Pct" > 60 THEN '⚠️ RISK: Over-reliance on hero products'
                 WHEN "Product_Segment" LIKE 'Core%' AND "GMV_Contribution_Pct" < 25 THEN '⚠️ URGENT: Need to push core products'
                 ELSE '✅ Healthy' END AS "Risk_Status"
  FROM product_segments)"""
GEO = """geographic AS (
  SELECT "Province", "Platform", count(DISTINCT "Order_ID") AS "Orders", sum("Net_Sales") AS "GMV", sum("Quantity") AS "Units_Sold"
  FROM lines GROUP BY 1, 2)"""
DAILY_GEO = """daily_geographic AS (
  SELECT "Order_Date_Only" AS "Date", "Province", "Platform", count(DISTINCT "Order_ID") AS "Orders",
    sum("Net_Sales") AS "GMV", sum("Quantity") AS "Units_Sold"
  FROM lines GROUP BY 1, 2, 3)"""


def ads_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One ad per value of ``k``, with text in the columns an export has as text."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value").cast(MONEY)
    sold = (F.col("event_type") == "purchase") & (F.col("k") % 25 != 0)
    large = sold & (F.col("value") >= 10)
    zero = F.lit(0).cast(MONEY)
    totals = events.withColumn("k", k).filter(F.col("k").isNotNull()).groupBy("k").agg(
        (F.count_if(F.col("event_type") == "view") * 100).alias("Impressions"),
        (F.count_if(F.col("event_type") == "click") * 10).alias("Clicks"),
        F.count_if(sold).alias("Orders"),
        F.count_if(large).alias("Direct_Orders"),
        F.coalesce(F.sum(F.when(sold, value)), zero).alias("Sales"),
        F.coalesce(F.sum(F.when(large, value)), zero).alias("Direct_Sales"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "click", value)), zero).alias("_clicked"),
    )
    factor = F.lit("0.1").cast("decimal(4,2)") + (F.col("k") % 10).cast("decimal(4,2)") * F.lit("0.2").cast("decimal(4,2)")
    return totals.select(
        F.concat(F.lit("Campaign_"), F.col("k")).alias("Ad_Name"),
        F.when(F.col("k") % 3 == 0, "search").when(F.col("k") % 3 == 1, "discovery").otherwise("shop").alias("Ad_Type"),
        F.when(F.col("k") % 4 == 0, "paused").otherwise("running").alias("Status"),
        "Impressions", "Clicks", "Orders", "Direct_Orders", F.col("Orders").alias("Products_Sold"),
        F.col("Sales").cast(MONEY), F.col("Direct_Sales").cast(MONEY),
        (F.col("_clicked") * factor).cast(MONEY).alias("Ad_Cost"),
        F.concat(F.col("k"), F.lit("%")).alias("CTR"),
        F.concat(F.lit("0."), F.col("k")).alias("Conversion_Rate"),
        F.concat(F.col("k"), F.lit(".5")).alias("ROAS"),
        F.concat(F.lit("1"), F.col("k"), F.lit("%")).alias("ACOS"),
    )


def ads(spark: SparkSession, folder: str) -> DataFrame:
    return clean_ads(ads_raw(spark, folder))


ADS_RAW = """ads_totals AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    count(*) FILTER (event_type = 'view') * 100 AS "Impressions", count(*) FILTER (event_type = 'click') * 10 AS "Clicks",
    count(*) FILTER (event_type = 'purchase' AND k % 25 <> 0) AS "Orders",
    count(*) FILTER (event_type = 'purchase' AND k % 25 <> 0 AND value >= 10) AS "Direct_Orders",
    coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (event_type = 'purchase' AND k % 25 <> 0), 0) AS "Sales",
    coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (event_type = 'purchase' AND k % 25 <> 0 AND value >= 10), 0) AS "Direct_Sales",
    coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (event_type = 'click'), 0) AS clicked
  FROM events GROUP BY 1),
ads_raw AS (
  SELECT 'Campaign_' || k AS "Ad_Name", CASE k % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'discovery' ELSE 'shop' END AS "Ad_Type",
    CASE k % 4 WHEN 0 THEN 'paused' ELSE 'running' END AS "Status", "Impressions", "Clicks", "Orders", "Direct_Orders",
    "Orders" AS "Products_Sold", "Sales", "Direct_Sales",
    CAST(clicked * (CAST(0.1 AS DECIMAL(4,2)) + CAST(k % 10 AS DECIMAL(4,2)) * CAST(0.2 AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS "Ad_Cost", k
  FROM ads_totals)"""
ADS = """ads_clean AS (
  SELECT *, 'marketplace' AS "Platform", CAST("Sales" AS DOUBLE) AS s, CAST("Ad_Cost" AS DOUBLE) AS c,
    CASE WHEN k > 1 THEN k / 100 ELSE k END AS "CTR", CAST('0.' || k AS DOUBLE) AS "Conversion_Rate",
    CASE WHEN c > 0 THEN s / c ELSE CAST(k || '.5' AS DOUBLE) END AS "ROAS",
    CASE WHEN s > 0 THEN c / s WHEN CAST('1' || k AS DOUBLE) > 1 THEN CAST('1' || k AS DOUBLE) / 100 ELSE 1 END AS "ACOS"
  FROM ads_raw),
ads_master AS (
  SELECT "Ad_Name", "Ad_Type", "Status", "Platform", "Impressions", "Clicks", "Orders", "Direct_Orders", "Products_Sold",
    "Sales", "Direct_Sales", "Ad_Cost",
    CASE WHEN "Impressions" > 0 THEN "Clicks" / "Impressions" ELSE 0 END AS "CTR",
    CASE WHEN "Clicks" > 0 THEN "Orders" / "Clicks" ELSE 0 END AS "Conversion_Rate",
    CASE WHEN c > 0 THEN s / c ELSE 0 END AS "ROAS", CASE WHEN s > 0 THEN c / s ELSE 0 END AS "ACOS",
    CASE WHEN "ROAS" >= 5 THEN '🚀 Excellent (ROAS ≥ 5)' WHEN "ROAS" >= 3 THEN '✅ Good (ROAS 3-5)'
         WHEN "ROAS" >= 1 THEN '⚠️ Break-even (ROAS 1-3)'
         WHEN "Orders" = 0 AND "Clicks" > 100 THEN '🔴 Bleeding (No sales, high clicks)'
         ELSE '📊 Needs Monitoring' END AS "Campaign_Health"
  FROM (SELECT * EXCLUDE ("ROAS", "ACOS", "CTR", "Conversion_Rate") FROM ads_clean))"""


def content(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Sessions and videos: one row per user, day and kind; the kind comes from the event's properties."""
    events = table(spark, folder, "events")
    live = F.coalesce(F.get_json_object("props", "$.k").cast("int") < 50, F.lit(False))
    events = events.withColumn("Content_Kind", F.when(live, "live").otherwise("video"))
    if kind:
        events = events.filter(F.col("Content_Kind") == kind)

    def number(event: str):
        return F.count_if(F.col("event_type") == event)

    grouped = events.groupBy("user_id", F.to_date("ts").alias("Report_Date"), "Content_Kind").agg(
        total(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("GMV"),
        number("purchase").alias("Orders"),
        (number("view") * 10).alias("Views"),
        (number("view") * 10).alias("Viewers"),
        number("click").alias("Likes"),
        number("signup").alias("Comments"),
        number("error").alias("Shares"),
    )
    return grouped.withColumns(
        {
            "Creator": F.concat(F.lit("creator_"), F.col("user_id")),
            "Platform": F.when(F.col("user_id") % 4 < 2, "marketplace").otherwise("social"),
            "Engagement_Rate": engagement_rate(),
        }
    )


CONTENT = """content AS (
  SELECT user_id, 'creator_' || user_id AS "Creator", CAST(ts AS DATE) AS "Report_Date",
    CASE WHEN user_id % 4 < 2 THEN 'marketplace' ELSE 'social' END AS "Platform",
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'live' ELSE 'video' END AS "Content_Kind",
    coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (event_type = 'purchase'), 0) AS "GMV",
    count(*) FILTER (event_type = 'purchase') AS "Orders",
    count(*) FILTER (event_type = 'view') * 10 AS "Views", count(*) FILTER (event_type = 'view') * 10 AS "Viewers",
    count(*) FILTER (event_type = 'click') AS "Likes", count(*) FILTER (event_type = 'signup') AS "Comments",
    count(*) FILTER (event_type = 'error') AS "Shares",
    CASE WHEN "Views" > 0 THEN ("Likes" + "Comments" + "Shares") / "Views" ELSE 0 END AS "Engagement_Rate"
  FROM events GROUP BY user_id, CAST(ts AS DATE), "Content_Kind"),
live AS (SELECT * FROM content WHERE "Content_Kind" = 'live'),
video AS (SELECT * FROM content WHERE "Content_Kind" = 'video')"""
