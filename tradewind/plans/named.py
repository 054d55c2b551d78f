"""The named queries over the master tables.

Every query takes the tables it reads by name; ``as_of`` replaces today's date and defaults to the newest
day of the daily table. The master tables are small (days, campaigns, provinces) or sorted with a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import change_pct, ratio_or_null, total, whole_table
from tradewind.operators import labels
from tradewind.operators.content import content_performance as content_union
from tradewind.sources import layouts


def _as_of(daily: DataFrame, as_of: date | None) -> date | None:
    """The newest day, from a scan of the date column alone; as a literal it bounds the scan of the other columns."""
    return as_of or daily.agg(F.max("Date")).first()[0]


def _since(as_of: date | None, days: int) -> Column:
    return F.col("Date") >= F.lit(as_of and as_of - timedelta(days=days)).cast("date")


def kpi_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.sum("Orders").alias("Total_Orders"),
        total("GMV").alias("Total_GMV"),
        total("Net_Revenue").alias("Total_Net_Revenue"),
        F.avg("AOV").alias("Average_AOV"),
        total("Units_Sold").alias("Total_Units"),
    )


def hero_kpis(daily: DataFrame, as_of: date | None = None) -> DataFrame:
    return daily.filter(_since(_as_of(daily, as_of), 30)).agg(
        F.sum("Orders").alias("Total_Orders"),
        total("GMV").alias("Total_GMV"),
        total("Net_Revenue").alias("Total_Net_Revenue"),
        F.avg("AOV").alias("Average_AOV"),
        total("Units_Sold").alias("Total_Units"),
        total("Total_Fees").alias("Total_Fees"),
        total("Commission").alias("Total_Commission"),
    )


def today_kpis(daily: DataFrame) -> DataFrame:
    return (
        daily.filter(F.col("Date") == F.lit(_as_of(daily, None)).cast("date"))
        .select(
            "Date", "Platform", "GMV", "Orders", "AOV", "GMV_Segment",
            (F.col("DoD_GMV_Growth") * 100).alias("DoD_Growth_Pct"),
            (F.col("WoW_GMV_Growth") * 100).alias("WoW_Growth_Pct"),
        )
    )


def daily_trend_view(daily: DataFrame) -> DataFrame:
    return daily.select(
        "Date", "Platform", "GMV", "Orders", "AOV", "GMV_Segment",
        "DoD_GMV_Growth", "WoW_GMV_Growth", "MoM_GMV_Growth",
    ).orderBy(F.desc("Date"), "Platform")


def daily_trend(daily: DataFrame, as_of: date | None = None, by_platform: bool = False) -> DataFrame:
    """Last 90 days with the GMV 1, 7 and 30 rows before, over all channels or per channel."""
    order = Window.partitionBy("Platform").orderBy("Date") if by_platform else Window.orderBy("Date", "Platform")
    previous = {"Previous_Day_GMV": 1, "Previous_Week_GMV": 7, "Previous_Month_GMV": 30}
    return (
        daily.filter(_since(_as_of(daily, as_of), 90))
        .select(
            "Date", "Platform", "GMV", "Orders", "AOV", "Net_Revenue", "GMV_Segment",
            *[F.lag("GMV", k).over(order).alias(name) for name, k in previous.items()],
        )
        .orderBy("Date", "Platform")
    )


def weekly_trend(daily: DataFrame) -> DataFrame:
    week = F.date_trunc("week", "Date").cast("date")
    return (
        daily.groupBy(week.alias("Week_Start"))
        .agg(
            total("GMV").alias("Weekly_GMV"),
            F.sum("Orders").alias("Weekly_Orders"),
            F.avg("AOV").alias("Weekly_AOV"),
            total("Net_Revenue").alias("Weekly_Net_Revenue"),
        )
        .orderBy(F.desc("Week_Start"))
    )


def monthly_trend(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy(F.trunc("Date", "month").alias("Month_Start"))
        .agg(
            total("GMV").alias("Monthly_GMV"),
            F.sum("Orders").alias("Monthly_Orders"),
            F.avg("AOV").alias("Monthly_AOV"),
            total("Net_Revenue").alias("Monthly_Net_Revenue"),
            total("Total_Fees").alias("Monthly_Fees"),
        )
        .orderBy(F.desc("Month_Start"))
    )


def top_products(products: DataFrame, n: int = 20) -> DataFrame:
    return (
        products.orderBy(F.desc("Total_GMV"), "Product_Name", "SKU", "Platform")
        .limit(n)
        .select(
            "Product_Name", "SKU", "Platform", "Product_Segment", "Total_GMV", "Total_Qty", "Avg_Price",
            "GMV_Contribution_Pct", "Risk_Status",
        )
    )


def product_segments(products: DataFrame) -> DataFrame:
    return (
        products.groupBy("Product_Segment")
        .agg(
            F.count("*").alias("Product_Count"),
            total("Total_GMV").alias("Segment_GMV"),
            total("Total_Qty").alias("Segment_Units"),
            F.avg("Avg_Price").alias("Avg_Price"),
            total("GMV_Contribution_Pct").alias("Total_Contribution"),
        )
        .orderBy(F.desc("Segment_GMV"))
    )


def product_risks(products: DataFrame) -> DataFrame:
    return (
        products.filter(F.col("Risk_Status") != labels.HEALTHY)
        .select("Product_Name", "SKU", "Platform", "Product_Segment", "Total_GMV", "GMV_Contribution_Pct", "Risk_Status")
        .orderBy(F.desc("Total_GMV"), "Product_Name", "SKU", "Platform")
    )


def ads_summary(ads: DataFrame) -> DataFrame:
    totals = ads.agg(
        F.sum("Impressions").alias("Total_Impressions"),
        F.sum("Clicks").alias("Total_Clicks"),
        F.sum("Orders").alias("Total_Orders"),
        total("Sales").alias("Total_Sales"),
        total("Ad_Cost").alias("Total_Ad_Spend"),
    )
    return totals.withColumns(
        {
            "Blended_ROAS": ratio_or_null("Total_Sales", "Total_Ad_Spend"),
            "ACOS_Pct": ratio_or_null("Total_Ad_Spend", "Total_Sales") * 100,
            "CTR_Pct": ratio_or_null("Total_Clicks", "Total_Impressions") * 100,
        }
    )


def top_campaigns(ads: DataFrame, running: str = layouts.ADS_RUNNING, n: int = 15) -> DataFrame:
    return (
        ads.filter(F.col("Status") == running)
        .orderBy(F.desc("ROAS"), "Ad_Name", "Ad_Type")
        .limit(n)
        .select(
            "Ad_Name", "Ad_Type", "Status", "Impressions", "Clicks", "Orders", "Sales", "Ad_Cost",
            "ROAS", "ACOS", "Campaign_Health",
        )
    )


def bleeding_campaigns(ads: DataFrame, min_clicks: int = 100) -> DataFrame:
    losing = (F.col("ROAS") < 1) | ((F.col("Orders") == 0) & (F.col("Clicks") > min_clicks))
    return (
        ads.filter(losing)
        .select("Ad_Name", "Ad_Type", "Impressions", "Clicks", "Orders", "Sales", "Ad_Cost", "ROAS", "Campaign_Health")
        .orderBy(F.desc("Ad_Cost"), "Ad_Name", "Ad_Type")
    )


def campaign_health_lists(ads: DataFrame, min_clicks: int = 50) -> DataFrame:
    """All campaigns of the five lists; filter ``Health_List`` for one of them."""
    return ads.withColumn("Health_List", labels.campaign_list(min_clicks)).filter(F.col("Health_List").isNotNull()).select(
        "Health_List", "Ad_Name", "Ad_Type", "Status", "Impressions", "Clicks", "Orders", "Sales", "Ad_Cost", "ROAS", "CTR"
    )


def campaign_health_counts(ads: DataFrame, min_clicks: int = 50) -> DataFrame:
    """Campaigns and spend per list; the spend of the bleeding list is what was wasted."""
    return campaign_health_lists(ads, min_clicks).groupBy("Health_List").agg(
        F.count("*").alias("Campaigns"), total("Ad_Cost").alias("Spend")
    )


def top_provinces(geographic: DataFrame, n: int = 20) -> DataFrame:
    return (
        geographic.orderBy(F.desc("GMV"), "Province", "Platform")
        .limit(n)
        .select(
            "Province", "Platform", "Orders", "GMV", "Units_Sold",
            ratio_or_null("GMV", "Orders").alias("Avg_Order_Value"),
        )
    )


def province_distribution(geographic: DataFrame) -> DataFrame:
    everything = F.sum("GMV").over(whole_table())
    return (
        geographic.withColumn("GMV_Share_Pct", ratio_or_null(F.col("GMV") * 100, everything))
        .filter(F.col("GMV") > 0)
        .select("Province", "Platform", "Orders", "GMV", "Units_Sold", "GMV_Share_Pct")
        .orderBy(F.desc("GMV"), "Province", "Platform")
    )


def gmv_segments(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("GMV_Segment")
        .agg(
            F.count("*").alias("Day_Count"),
            total("GMV").alias("Segment_GMV"),
            F.avg("GMV").alias("Avg_Daily_GMV"),
            F.avg("Orders").alias("Avg_Daily_Orders"),
            F.min("Date").alias("First_Date"),
            F.max("Date").alias("Last_Date"),
        )
        .orderBy(F.desc("Segment_GMV"))
    )


def aov_segments(daily: DataFrame) -> DataFrame:
    return daily.groupBy("AOV_Segment").agg(
        F.count("*").alias("Day_Count"),
        F.avg("AOV").alias("Avg_AOV"),
        F.avg("GMV").alias("Avg_GMV"),
        F.avg("Orders").alias("Avg_Orders"),
    )


def period_comparison(daily: DataFrame, as_of: date | None = None) -> DataFrame:
    """The last 7 days against the 7 before, in one pass over the daily table."""
    as_of = _as_of(daily, as_of)
    current = _since(as_of, 7)
    previous = _since(as_of, 14) & ~current

    def sum_if(condition: Column, column: str) -> Column:
        return total(F.when(condition, F.col(column)))

    row = daily.filter(_since(as_of, 14)).agg(
        sum_if(current, "GMV").alias("Current_GMV"),
        sum_if(previous, "GMV").alias("Previous_GMV"),
        sum_if(current, "Orders").alias("Current_Orders"),
        sum_if(previous, "Orders").alias("Previous_Orders"),
        F.avg(F.when(current, F.col("AOV"))).alias("Current_AOV"),
        F.avg(F.when(previous, F.col("AOV"))).alias("Previous_AOV"),
    )
    return row.withColumns(
        {
            "WoW_Growth_Pct": change_pct("Current_GMV", "Previous_GMV"),
            "Orders_Growth_Pct": change_pct("Current_Orders", "Previous_Orders"),
            "AOV_Growth_Pct": change_pct("Current_AOV", "Previous_AOV"),
        }
    )


def content_performance(live: DataFrame, video: DataFrame) -> DataFrame:
    return content_union(live, video).orderBy(F.desc("Report_Date"), "Content_Type")


# Query name -> function and the tables it reads.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "kpi_summary": (kpi_summary, ("daily_sales",)),
    "hero_kpis": (hero_kpis, ("daily_sales",)),
    "today_kpis": (today_kpis, ("daily_sales",)),
    "daily_trend": (daily_trend, ("daily_sales",)),
    "weekly_trend": (weekly_trend, ("daily_sales",)),
    "monthly_trend": (monthly_trend, ("daily_sales",)),
    "top_products": (top_products, ("products",)),
    "product_segments": (product_segments, ("products",)),
    "product_risks": (product_risks, ("products",)),
    "ads_summary": (ads_summary, ("ads_performance",)),
    "top_campaigns": (top_campaigns, ("ads_performance",)),
    "bleeding_campaigns": (bleeding_campaigns, ("ads_performance",)),
    "top_provinces": (top_provinces, ("geographic",)),
    "province_distribution": (province_distribution, ("geographic",)),
    "gmv_segments": (gmv_segments, ("daily_sales",)),
    "aov_segments": (aov_segments, ("daily_sales",)),
    "period_comparison": (period_comparison, ("daily_sales",)),
    "content_performance": (content_performance, ("combined_live", "combined_video")),
}


def run_query(name: str, tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """Run a named query on the given tables."""
    if name not in REGISTRY:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(REGISTRY)}")
    function, needed = REGISTRY[name]
    return function(*[tables[t] for t in needed], **options)
