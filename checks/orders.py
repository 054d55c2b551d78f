"""Cleaning, master tables, named queries and period views over the order lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.adapters import (
    ADS, ADS_RAW, ALL, DAILY, DAILY_GEO, GEO, KEYWORD, LINES, PRODUCTS, RAW_LINES, VALID, ads, order_lines, table,
)
from checks.base import Check
from tradewind.operators import channels, masters, periods
from tradewind.plans import named, refresh
from tradewind.session import stage

_LINES = (RAW_LINES, LINES)
_DAILY = (*_LINES, DAILY)
_PRODUCTS = (*_LINES, PRODUCTS)
_GEO = (*_LINES, GEO)

START, END = date(2000, 7, 1), date(2001, 6, 30)
PERIOD = "DATE '2000-07-01' AND DATE '2001-06-30'"
BEFORE = "DATE '1999-07-02' AND DATE '2000-06-30'"

_MASTER_SUMS = "Orders:l GMV:f4 Net_Revenue:f4 Units_Sold:f4 Total_Fees:f4 Total_Discount:f4 Commission:f4 Transaction_Fee:f4 Service_Fee:f4 AOV:f6"
_KEY = "Order_ID:s Line:i"


def _daily(spark, folder):
    return masters.daily_sales(order_lines(spark, folder))


def _products(spark, folder):
    return masters.product_master(order_lines(spark, folder, "product"))


def _geographic(spark, folder):
    return masters.geographic(order_lines(spark, folder, "province"))


def _direct(spark, folder):
    """Orders as direct-sales documents, with rows that have to be dropped, through the cleaner."""
    orders = table(spark, folder, "orders")
    raw = orders.select(
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderkey").cast("string")).alias("เลขที่เอกสาร"),
        F.when(F.col("o_orderstatus") == "P", F.lit("total")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("วัน/เดือน/ปี"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("ชื่อลูกค้า"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("มูลค่า"),
        F.lit("n/a").alias("ภาษีมูลค่าเพิ่ม"),
        F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")).alias("ยอดรวมสุทธิ"),
    )
    return channels.clean_direct_sales(raw)


def _all_orders(spark, folder):
    # Joined and stored once; the channels are parts of the stored lines.
    lines = stage(order_lines(spark, folder, "product", "province"), "order-lines")
    parts = [lines.filter(F.col("Platform") == p) for p in ("marketplace", "social", "direct")]
    return channels.all_orders(*parts)


def _period_products(spark, folder):
    lines = order_lines(spark, folder, "product")
    return periods.products_in_period(lines, START, END)


_PERIOD_PRODUCTS = f"""period_totals AS (
  SELECT "Product_Name", "SKU", sum("Net_Sales") AS "Total_GMV", sum("Quantity") AS "Total_Qty", count(DISTINCT "Order_ID") AS "Orders",
    CAST(sum("Net_Sales") AS DOUBLE) AS g, CAST(sum("Quantity") AS DOUBLE) AS q
  FROM lines WHERE "Order_Date_Only" BETWEEN {PERIOD} GROUP BY 1, 2),
period_limits AS (SELECT quantile_cont(g, 0.5) AS mg, quantile_cont(q, 0.5) AS mq FROM period_totals),
period_products AS (
  SELECT *, g / q AS "Avg_Price",
    CASE WHEN g >= mg AND q >= mq THEN 'Star (High GMV, High Volume)' WHEN g >= mg THEN 'Hero (High GMV)'
         WHEN q >= mq THEN 'Volume (High Volume, Low GMV)' ELSE 'Core (Average)' END AS "Product_Segment"
  FROM period_totals, period_limits)"""
_PERIOD_WITH = (*_LINES, _PERIOD_PRODUCTS)

_MARGIN = 'CASE WHEN "Current_GMV" > 0 THEN "Current_Net_Revenue" / "Current_GMV" * 100 ELSE 0 END AS "Net_Margin_Pct"'


def _change(column: str) -> str:
    now, then = f'"Current_{column}"', f'"Previous_{column}"'
    return f'CASE WHEN "Has_Previous" AND {then} > 0 THEN ({now} - {then}) / {then} * 100 END AS "{column}_Change_Pct"'


def _sum(column: str, span: str, name: str) -> str:
    return f'coalesce(CAST(sum("{column}") FILTER ("Date" BETWEEN {span}) AS DOUBLE), 0) AS "{name}_{column}"'


_HERO = f"""SELECT *, {", ".join(_change(c) for c in ("GMV", "Orders", "AOV", "Net_Revenue"))}, {_MARGIN} FROM (
  SELECT {", ".join(_sum(c, PERIOD, "Current") for c in ("GMV", "Orders", "Net_Revenue", "Units_Sold"))},
    {", ".join(_sum(c, BEFORE, "Previous") for c in ("GMV", "Orders", "Net_Revenue", "Units_Sold"))},
    coalesce(avg("AOV") FILTER ("Date" BETWEEN {PERIOD}), 0) AS "Current_AOV",
    coalesce(avg("AOV") FILTER ("Date" BETWEEN {BEFORE}), 0) AS "Previous_AOV",
    min("Date") <= DATE '2000-06-30' AND count(*) FILTER ("Date" BETWEEN {BEFORE}) > 0 AS "Has_Previous"
  FROM daily_totals)"""

_AS_OF = '(SELECT max("Date") FROM daily_sales)'

_PERIODS = """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi,
    CAST(date_trunc('year', max(o_orderdate)) AS DATE) AS y, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS m FROM orders),
  p AS (
    SELECT 'Today' AS n, hi AS s, hi AS e FROM b UNION ALL SELECT 'This Week', hi - 7, hi FROM b
    UNION ALL SELECT 'This Month', m, hi FROM b UNION ALL SELECT 'This Year', y, hi FROM b
    UNION ALL SELECT 'Q1', y, least(make_date(year(hi), 3, 31), hi) FROM b
    UNION ALL SELECT 'Q2', make_date(year(hi), 4, 1), least(make_date(year(hi), 6, 30), hi) FROM b
    UNION ALL SELECT 'Q3', greatest(make_date(year(hi), 7, 1), lo), least(make_date(year(hi), 9, 30), hi) FROM b
    UNION ALL SELECT 'Q4', greatest(make_date(year(hi), 10, 1), lo), hi FROM b
    UNION ALL SELECT 'Last 7 Days', hi - 7, hi FROM b UNION ALL SELECT 'Last 30 Days', hi - 30, hi FROM b
    UNION ALL SELECT 'Last 90 Days', hi - 90, hi FROM b UNION ALL SELECT 'Last 12 Months', hi - 365, hi FROM b
    UNION ALL SELECT 'All Time', lo, hi FROM b)
  SELECT n AS "Period", s AS "Start_Date", e AS "End_Date" FROM p WHERE n NOT IN ('Q3', 'Q4') OR s <= e"""

_SUMMARY = """SELECT 'First_Day' AS "Metric", CAST(date_diff('day', DATE '1970-01-01', min("Date")) AS DOUBLE) AS "Value" FROM daily_sales
  UNION ALL SELECT 'Last_Day', date_diff('day', DATE '1970-01-01', max("Date")) FROM daily_sales
  UNION ALL SELECT 'Total_Orders', sum("Orders") FROM daily_sales
  UNION ALL SELECT 'Total_GMV', CAST(sum("GMV") AS DOUBLE) FROM daily_sales
  UNION ALL SELECT 'Total_Net_Revenue', CAST(sum("Net_Revenue") AS DOUBLE) FROM daily_sales
  UNION ALL SELECT 'Average_AOV', avg("AOV") FROM daily_sales
  UNION ALL SELECT 'Products', count(*) FROM products
  UNION ALL SELECT 'Star_Products', count(*) FROM products WHERE "Product_Segment" LIKE '%Star%'
  UNION ALL SELECT 'Hero_Products', count(*) FROM products WHERE "Product_Segment" LIKE '%Hero%'
  UNION ALL SELECT 'Campaigns', count(*) FROM ads_master
  UNION ALL SELECT 'Ad_Spend', CAST(sum("Ad_Cost") AS DOUBLE) FROM ads_master
  UNION ALL SELECT 'Ad_Sales', CAST(sum("Sales") AS DOUBLE) FROM ads_master
  UNION ALL SELECT 'Average_ROAS', avg("ROAS") FROM ads_master"""

CHECKS = [
    Check(
        "daily_sales",
        f"Date:d Platform:s {_MASTER_SUMS} DoD_GMV_Growth:f6 WoW_GMV_Growth:f6 MoM_GMV_Growth:f6 QoQ_GMV_Growth:f6 GMV_Segment:s AOV_Segment:s",
        _daily,
        "SELECT * FROM daily_sales",
        _DAILY,
    ),
    Check(
        "filter_status",
        f"{_KEY} Order_Status:s Net_Sales:f4",
        lambda s, f: channels.keep_statuses(order_lines(s, f, valid=False), VALID),
        "SELECT * FROM lines",
        _LINES,
    ),
    Check(
        "filter_keywords",
        f"{_KEY} Product_Name:s Net_Sales:f4",
        lambda s, f: channels.drop_keywords(order_lines(s, f, "product"), [KEYWORD]),
        "SELECT * FROM lines WHERE NOT contains(lower(\"Product_Name\"), 'ring')",
        _LINES,
    ),
    Check(
        "clean_orders",
        f"{_KEY} Order_Status:s Order_Date:t Order_Date_Only:d Product_Name:s SKU:s Quantity:f4 Original_Price:f4 Net_Sales:f4 "
        "Total_Fees:f4 True_Net_Revenue:f4 Total_Discount:f4 Platform:s Province:s Buyer_Username:s",
        lambda s, f: channels.drop_keywords(order_lines(s, f, *ALL), [KEYWORD]),
        "SELECT * FROM lines WHERE NOT contains(lower(\"Product_Name\"), 'ring')",
        _LINES,
    ),
    Check(
        "clean_direct",
        "Order_ID:s Order_Date:t Order_Date_Only:d Customer_Type:s Sales_Channel:s Net_Sales:f4 VAT:f4 Total_Amount:f4 "
        "Quantity:f4 Return_Qty:f4 Total_Discount:f4 Total_Fees:f4 True_Net_Revenue:f4 Product_Name:s SKU:s Province:s Platform:s",
        _direct,
        """SELECT o_orderkey AS "Order_ID", o_orderdate AS "Order_Date", CAST(o_orderdate AS DATE) AS "Order_Date_Only",
             o_orderpriority AS "Customer_Type", o_orderpriority AS "Sales_Channel", round(o_totalprice, 2) AS "Net_Sales", 0 AS "VAT",
             round(o_totalprice, 2) AS "Total_Amount", 1 AS "Quantity", 0 AS "Return_Qty", 0 AS "Total_Discount", 0 AS "Total_Fees",
             round(o_totalprice, 2) AS "True_Net_Revenue", 'Direct Sale' AS "Product_Name", 'N/A' AS "SKU", 'Unknown' AS "Province",
             'direct' AS "Platform"
           FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW') AND o_orderstatus <> 'P'""",
    ),
    Check(
        "all_orders",
        "Order_ID:s Order_Status:s Order_Date:t Product_Name:s SKU:s Quantity:f4 Net_Sales:f4 True_Net_Revenue:f4 Platform:s Province:s",
        _all_orders,
        """SELECT "Order_ID", "Order_Status", "Order_Date", "Product_Name", "SKU", "Quantity", "Net_Sales", "True_Net_Revenue",
             "Platform", "Province" FROM lines WHERE "Platform" <> 'direct'
           UNION ALL SELECT "Order_ID", NULL, "Order_Date", 'Direct Sale', 'N/A', "Quantity", "Net_Sales", "Net_Sales", "Platform", 'Unknown'
           FROM lines WHERE "Platform" = 'direct'""",
        _LINES,
    ),
    Check(
        "run_summary",
        "Metric:s Value:f4",
        lambda s, f: refresh.run_summary(
            _daily(s, f), _products(s, f), masters.ads_master(ads(s, f))
        ),
        _SUMMARY,
        (*_DAILY, PRODUCTS, ADS_RAW, ADS),
    ),
    Check(
        "daily_growth",
        "Date:d Platform:s GMV:f4 DoD_GMV_Growth:f6 WoW_GMV_Growth:f6 MoM_GMV_Growth:f6 QoQ_GMV_Growth:f6",
        lambda s, f: masters.with_growth(masters.daily_totals(order_lines(s, f))),
        "SELECT * FROM daily_sales",
        _DAILY,
    ),
    Check(
        "daily_segments",
        "Date:d Platform:s GMV:f4 AOV:f6 GMV_Segment:s AOV_Segment:s",
        lambda s, f: masters.with_segments(masters.daily_totals(order_lines(s, f))),
        "SELECT * FROM daily_sales",
        _DAILY,
    ),
    Check(
        "gmv_quantiles",
        "P20_GMV:f4 Median_GMV:f4 P80_GMV:f4 Mean_AOV:f4 Rows:l Days:l",
        lambda s, f: masters.gmv_quantiles(masters.daily_totals(order_lines(s, f))),
        """SELECT quantile_cont(CAST("GMV" AS DOUBLE), 0.2) AS "P20_GMV", quantile_cont(CAST("GMV" AS DOUBLE), 0.5) AS "Median_GMV",
             quantile_cont(CAST("GMV" AS DOUBLE), 0.8) AS "P80_GMV", avg("AOV") AS "Mean_AOV", count(*) AS "Rows",
             count(DISTINCT "Date") AS "Days" FROM daily_totals""",
        _DAILY,
    ),
    Check(
        "product_master",
        "Product_Name:s SKU:s Platform:s Orders:l Total_GMV:f4 Net_Revenue:f4 Total_Qty:f4 Total_Discount:f4 Avg_Price:f6 "
        "Product_Segment:s GMV_Contribution_Pct:f2 Risk_Status:s",
        _products,
        "SELECT * FROM products",
        _PRODUCTS,
    ),
    Check("geographic", "Province:s Platform:s Orders:l GMV:f4 Units_Sold:f4", _geographic, "SELECT * FROM geographic", _GEO),
    Check(
        "daily_geographic",
        "Date:d Province:s Platform:s Orders:l GMV:f4 Units_Sold:f4",
        lambda s, f: masters.daily_geographic(order_lines(s, f, "province")),
        "SELECT * FROM daily_geographic",
        (*_LINES, DAILY_GEO),
    ),
    Check(
        "hero_kpis",
        "Total_Orders:l Total_GMV:f4 Total_Net_Revenue:f4 Average_AOV:f4 Total_Units:f4 Total_Fees:f4 Total_Commission:f4",
        lambda s, f: named.hero_kpis(masters.daily_totals(order_lines(s, f))),
        f"""SELECT sum("Orders") AS "Total_Orders", sum("GMV") AS "Total_GMV", sum("Net_Revenue") AS "Total_Net_Revenue",
             avg("AOV") AS "Average_AOV", sum("Units_Sold") AS "Total_Units", sum("Total_Fees") AS "Total_Fees",
             sum("Commission") AS "Total_Commission" FROM daily_sales WHERE "Date" >= {_AS_OF} - 30""",
        _DAILY,
    ),
    Check(
        "kpi_summary",
        "Total_Orders:l Total_GMV:f4 Total_Net_Revenue:f4 Average_AOV:f4 Total_Units:f4",
        lambda s, f: named.kpi_summary(masters.daily_totals(order_lines(s, f))),
        """SELECT sum("Orders") AS "Total_Orders", sum("GMV") AS "Total_GMV", sum("Net_Revenue") AS "Total_Net_Revenue",
             avg("AOV") AS "Average_AOV", sum("Units_Sold") AS "Total_Units" FROM daily_sales""",
        _DAILY,
    ),
    Check(
        "today_kpis",
        "Date:d Platform:s GMV:f4 Orders:l AOV:f6 GMV_Segment:s DoD_Growth_Pct:f4 WoW_Growth_Pct:f4",
        lambda s, f: named.today_kpis(_daily(s, f)),
        f"""SELECT *, "DoD_GMV_Growth" * 100 AS "DoD_Growth_Pct", "WoW_GMV_Growth" * 100 AS "WoW_Growth_Pct"
            FROM daily_sales WHERE "Date" = {_AS_OF}""",
        _DAILY,
    ),
    Check(
        "daily_trend",
        "Date:d Platform:s GMV:f4 Orders:l AOV:f6 GMV_Segment:s DoD_GMV_Growth:f6 WoW_GMV_Growth:f6 MoM_GMV_Growth:f6",
        lambda s, f: named.daily_trend_view(_daily(s, f)),
        "SELECT * FROM daily_sales",
        _DAILY,
    ),
    Check(
        "daily_trend_lag",
        "Date:d Platform:s GMV:f4 Orders:l AOV:f6 Net_Revenue:f4 GMV_Segment:s Previous_Day_GMV:f4 Previous_Week_GMV:f4 Previous_Month_GMV:f4",
        lambda s, f: named.daily_trend(_daily(s, f)),
        f"""SELECT *, lag("GMV") OVER w AS "Previous_Day_GMV", lag("GMV", 7) OVER w AS "Previous_Week_GMV",
             lag("GMV", 30) OVER w AS "Previous_Month_GMV" FROM daily_sales WHERE "Date" >= {_AS_OF} - 90
            WINDOW w AS (ORDER BY "Date", "Platform")""",
        _DAILY,
    ),
    Check(
        "weekly_trend",
        "Week_Start:d Weekly_GMV:f4 Weekly_Orders:l Weekly_AOV:f4 Weekly_Net_Revenue:f4",
        lambda s, f: named.weekly_trend(masters.daily_totals(order_lines(s, f))),
        """SELECT date_trunc('week', "Date") AS "Week_Start", sum("GMV") AS "Weekly_GMV", sum("Orders") AS "Weekly_Orders",
             avg("AOV") AS "Weekly_AOV", sum("Net_Revenue") AS "Weekly_Net_Revenue" FROM daily_totals GROUP BY 1""",
        _DAILY,
    ),
    Check(
        "monthly_trend",
        "Month_Start:d Monthly_GMV:f4 Monthly_Orders:l Monthly_AOV:f4 Monthly_Net_Revenue:f4 Monthly_Fees:f4",
        lambda s, f: named.monthly_trend(masters.daily_totals(order_lines(s, f))),
        """SELECT date_trunc('month', "Date") AS "Month_Start", sum("GMV") AS "Monthly_GMV", sum("Orders") AS "Monthly_Orders",
             avg("AOV") AS "Monthly_AOV", sum("Net_Revenue") AS "Monthly_Net_Revenue", sum("Total_Fees") AS "Monthly_Fees"
           FROM daily_totals GROUP BY 1""",
        _DAILY,
    ),
    Check(
        "top_products",
        "Product_Name:s SKU:s Platform:s Product_Segment:s Total_GMV:f4 Total_Qty:f4 Avg_Price:f6 GMV_Contribution_Pct:f2 Risk_Status:s",
        lambda s, f: named.top_products(_products(s, f)),
        'SELECT * FROM products ORDER BY "Total_GMV" DESC, "Product_Name", "SKU", "Platform" LIMIT 20',
        _PRODUCTS,
    ),
    Check(
        "product_segments",
        "Product_Segment:s Product_Count:l Segment_GMV:f4 Segment_Units:f4 Avg_Price:f4 Total_Contribution:f2",
        lambda s, f: named.product_segments(_products(s, f)),
        """SELECT "Product_Segment", count(*) AS "Product_Count", sum("Total_GMV") AS "Segment_GMV", sum("Total_Qty") AS "Segment_Units",
             avg("Avg_Price") AS "Avg_Price", sum("GMV_Contribution_Pct") AS "Total_Contribution" FROM products GROUP BY 1""",
        _PRODUCTS,
    ),
    Check(
        "product_risks",
        "Product_Name:s SKU:s Platform:s Product_Segment:s Total_GMV:f4 GMV_Contribution_Pct:f2 Risk_Status:s",
        lambda s, f: named.product_risks(_products(s, f)),
        "SELECT * FROM products WHERE \"Risk_Status\" <> '✅ Healthy'",
        _PRODUCTS,
    ),
    Check(
        "top_provinces",
        "Province:s Platform:s Orders:l GMV:f4 Units_Sold:f4 Avg_Order_Value:f6",
        lambda s, f: named.top_provinces(_geographic(s, f)),
        """SELECT *, CAST("GMV" AS DOUBLE) / nullif("Orders", 0) AS "Avg_Order_Value" FROM geographic
           ORDER BY "GMV" DESC, "Province", "Platform" LIMIT 20""",
        _GEO,
    ),
    Check(
        "province_distribution",
        "Province:s Platform:s Orders:l GMV:f4 Units_Sold:f4 GMV_Share_Pct:f6",
        lambda s, f: named.province_distribution(_geographic(s, f)),
        """SELECT *, CAST("GMV" * 100 AS DOUBLE) / CAST((SELECT sum("GMV") FROM geographic) AS DOUBLE) AS "GMV_Share_Pct"
           FROM geographic WHERE "GMV" > 0""",
        _GEO,
    ),
    Check(
        "gmv_segments",
        "GMV_Segment:s Day_Count:l Segment_GMV:f4 Avg_Daily_GMV:f4 Avg_Daily_Orders:f6 First_Date:d Last_Date:d",
        lambda s, f: named.gmv_segments(_daily(s, f)),
        """SELECT "GMV_Segment", count(*) AS "Day_Count", sum("GMV") AS "Segment_GMV", CAST(sum("GMV") AS DOUBLE) / count(*) AS "Avg_Daily_GMV",
             avg("Orders") AS "Avg_Daily_Orders", min("Date") AS "First_Date", max("Date") AS "Last_Date" FROM daily_sales GROUP BY 1""",
        _DAILY,
    ),
    Check(
        "aov_segments",
        "AOV_Segment:s Day_Count:l Avg_AOV:f4 Avg_GMV:f4 Avg_Orders:f6",
        lambda s, f: named.aov_segments(_daily(s, f)),
        """SELECT "AOV_Segment", count(*) AS "Day_Count", avg("AOV") AS "Avg_AOV", CAST(sum("GMV") AS DOUBLE) / count(*) AS "Avg_GMV",
             avg("Orders") AS "Avg_Orders" FROM daily_sales GROUP BY 1""",
        _DAILY,
    ),
    Check(
        "period_comparison",
        "Current_GMV:f4 Previous_GMV:f4 WoW_Growth_Pct:f4 Current_Orders:l Previous_Orders:l Orders_Growth_Pct:f4 "
        "Current_AOV:f4 Previous_AOV:f4 AOV_Growth_Pct:f4",
        lambda s, f: named.period_comparison(masters.daily_totals(order_lines(s, f))),
        f"""SELECT c.g AS "Current_GMV", p.g AS "Previous_GMV", CAST(c.g - p.g AS DOUBLE) / nullif(CAST(p.g AS DOUBLE), 0) * 100 AS "WoW_Growth_Pct",
             c.o AS "Current_Orders", p.o AS "Previous_Orders", CAST(c.o - p.o AS DOUBLE) / nullif(p.o, 0) * 100 AS "Orders_Growth_Pct",
             c.a AS "Current_AOV", p.a AS "Previous_AOV", (c.a - p.a) / nullif(p.a, 0) * 100 AS "AOV_Growth_Pct"
            FROM (SELECT sum("GMV") AS g, sum("Orders") AS o, avg("AOV") AS a FROM daily_sales WHERE "Date" >= {_AS_OF} - 7) c,
                 (SELECT sum("GMV") AS g, sum("Orders") AS o, avg("AOV") AS a FROM daily_sales
                  WHERE "Date" >= {_AS_OF} - 14 AND "Date" < {_AS_OF} - 7) p""",
        _DAILY,
    ),
    Check(
        "period_filter",
        f"{_KEY} Order_Date:t Platform:s Net_Sales:f4",
        lambda s, f: periods.in_period(order_lines(s, f), "Order_Date", START, END, "marketplace"),
        f"SELECT * FROM lines WHERE \"Order_Date_Only\" BETWEEN {PERIOD} AND \"Platform\" = 'marketplace'",
        _LINES,
    ),
    Check(
        "named_periods",
        "Period:s Start_Date:d End_Date:d",
        lambda s, f: periods.named_periods(periods.bounds((table(s, f, "orders"), "o_orderdate"))),
        _PERIODS,
    ),
    Check(
        "hero_comparison",
        "Current_GMV:f4 Current_Orders:l Current_Net_Revenue:f4 Current_Units_Sold:f4 Current_AOV:f4 Previous_GMV:f4 Previous_Orders:l "
        "Previous_Net_Revenue:f4 Previous_Units_Sold:f4 Previous_AOV:f4 Has_Previous:b GMV_Change_Pct:f4 Orders_Change_Pct:f4 "
        "AOV_Change_Pct:f4 Net_Revenue_Change_Pct:f4 Net_Margin_Pct:f4",
        lambda s, f: periods.hero_comparison(masters.daily_totals(order_lines(s, f)), START, END),
        _HERO,
        _DAILY,
    ),
    Check(
        "trend_vs_previous",
        "Date:d Platform:s Current_GMV:f4 Previous_GMV:f4",
        lambda s, f: periods.trend_vs_previous(masters.daily_totals(order_lines(s, f)), START, END),
        f"""SELECT coalesce(c."Date", p.d) AS "Date", coalesce(c."Platform", p."Platform") AS "Platform",
             c."GMV" AS "Current_GMV", p."GMV" AS "Previous_GMV"
            FROM (SELECT * FROM daily_totals WHERE "Date" BETWEEN {PERIOD}) c
            FULL JOIN (SELECT "Date" + 365 AS d, "Platform", "GMV" FROM daily_totals WHERE "Date" BETWEEN {BEFORE}) p
            ON c."Date" = p.d AND c."Platform" = p."Platform" """,
        _DAILY,
    ),
    Check(
        "platform_breakdown",
        "Platform:s GMV:f4 Orders:l Net_Revenue:f4 Units_Sold:f4 Min_Date:d Max_Date:d Days:l GMV_Share_Pct:f6 Orders_Share_Pct:f6 Net_Revenue_Share_Pct:f6",
        lambda s, f: periods.platform_breakdown(
            masters.daily_totals(periods.in_period(order_lines(s, f), "Order_Date", START, END))
        ),
        f"""SELECT *, CAST("GMV" AS DOUBLE) / CAST(sum("GMV") OVER () AS DOUBLE) * 100 AS "GMV_Share_Pct",
             CAST("Orders" AS DOUBLE) / CAST(sum("Orders") OVER () AS DOUBLE) * 100 AS "Orders_Share_Pct",
             CAST("Net_Revenue" AS DOUBLE) / CAST(sum("Net_Revenue") OVER () AS DOUBLE) * 100 AS "Net_Revenue_Share_Pct"
            FROM (SELECT "Platform", sum("GMV") AS "GMV", sum("Orders") AS "Orders", sum("Net_Revenue") AS "Net_Revenue",
              sum("Units_Sold") AS "Units_Sold", min("Date") AS "Min_Date", max("Date") AS "Max_Date", count(*) AS "Days"
              FROM daily_totals WHERE "Date" BETWEEN {PERIOD} GROUP BY 1)""",
        _DAILY,
    ),
    Check(
        "products_in_period",
        "Product_Name:s SKU:s Total_GMV:f4 Total_Qty:f4 Orders:l Product_Segment:s Avg_Price:f6",
        _period_products,
        "SELECT * FROM period_products",
        _PERIOD_WITH,
    ),
    Check(
        "period_product_segments",
        "Segment:s Products:l GMV:f4 Units:f4",
        lambda s, f: periods.period_product_segments(_period_products(s, f)),
        """SELECT "Product_Segment" AS "Segment", count(*) AS "Products", sum("Total_GMV") AS "GMV", sum("Total_Qty") AS "Units"
           FROM period_products GROUP BY 1""",
        _PERIOD_WITH,
    ),
    Check(
        "top8_products",
        "Product_Name:s SKU:s Total_GMV:f4 Orders:l",
        lambda s, f: periods.largest_products(_period_products(s, f), 8),
        'SELECT * FROM period_products ORDER BY "Total_GMV" DESC, "Product_Name", "SKU" LIMIT 8',
        _PERIOD_WITH,
    ),
    Check(
        "lowest_products",
        "Product_Name:s SKU:s Total_GMV:f4 Orders:l",
        lambda s, f: periods.smallest_products(_period_products(s, f), 3),
        'SELECT * FROM period_products ORDER BY "Total_GMV", "Product_Name", "SKU" LIMIT 3',
        _PERIOD_WITH,
    ),
    Check(
        "province_concentration",
        "Province:s GMV:f4 Orders:l Units_Sold:f4 Position:i Provinces:l Top1_Share_Pct:f6 Top5_Share_Pct:f6",
        lambda s, f: periods.province_concentration(
            periods.provinces_in_period(
                masters.daily_geographic(periods.in_period(order_lines(s, f, "province"), "Order_Date", START, END)), START, END
            )
        ),
        f"""SELECT * FROM (SELECT *, count(*) OVER () AS "Provinces",
              CAST(sum("GMV") FILTER ("Position" <= 1) OVER () AS DOUBLE) / CAST(sum("GMV") OVER () AS DOUBLE) * 100 AS "Top1_Share_Pct",
              CAST(sum("GMV") FILTER ("Position" <= 5) OVER () AS DOUBLE) / CAST(sum("GMV") OVER () AS DOUBLE) * 100 AS "Top5_Share_Pct"
            FROM (SELECT *, row_number() OVER (ORDER BY "GMV" DESC, "Province") AS "Position"
              FROM (SELECT "Province", sum("GMV") AS "GMV", sum("Orders") AS "Orders", sum("Units_Sold") AS "Units_Sold"
                    FROM daily_geographic WHERE "Date" BETWEEN {PERIOD} GROUP BY 1))) WHERE "Position" <= 15""",
        (*_LINES, DAILY_GEO),
    ),
    Check(
        "last_day_growth",
        "Platform:s Date:d GMV:f4 DoD_GMV_Growth:f6 WoW_GMV_Growth:f6 MoM_GMV_Growth:f6",
        lambda s, f: periods.last_day_growth(masters.with_growth(masters.daily_totals(order_lines(s, f)))),
        'SELECT * FROM daily_sales QUALIFY row_number() OVER (PARTITION BY "Platform" ORDER BY "Date" DESC) = 1',
        _DAILY,
    ),
    Check(
        "recent_days",
        "Date:d Platform:s GMV:f4 Orders:l AOV:f6 GMV_Segment:s DoD_GMV_Growth:f6",
        lambda s, f: periods.recent_days(_daily(s, f)),
        'SELECT * FROM daily_sales ORDER BY "Date" DESC, "Platform" DESC LIMIT 14',
        _DAILY,
    ),
]
