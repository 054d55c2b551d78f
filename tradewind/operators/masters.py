"""Master tables built from the unified order lines and the cleaned ads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import growth, ratio, total, whole_table
from tradewind.operators import labels
from tradewind.operators.order_statistics import quantiles, value_ranges
from tradewind.session import stage

# Growth columns of the daily table and the distance in rows they look back.
GROWTH_LAGS = {"DoD_GMV_Growth": 1, "WoW_GMV_Growth": 7, "MoM_GMV_Growth": 30, "QoQ_GMV_Growth": 90}

_DAILY_SUMS = {
    "GMV": "Net_Sales",
    "Net_Revenue": "True_Net_Revenue",
    "Units_Sold": "Quantity",
    "Total_Fees": "Total_Fees",
    "Total_Discount": "Total_Discount",
    "Commission": "Commission",
    "Transaction_Fee": "Transaction_Fee",
    "Service_Fee": "Service_Fee",
}

def _grouped(lines: DataFrame, keys: dict, sums: dict, by: Sequence[str] = ()) -> DataFrame:
    """Distinct orders and sums per key; rows with a null key are dropped as in a pandas group-by.

    With ``by``, partial results: one per value of these columns, to be added up by ``_added``."""
    for source in keys.values():
        lines = lines.filter(F.col(source).isNotNull())
    return lines.groupBy(*by, *[F.col(s).alias(k) for k, s in keys.items()]).agg(
        F.count_distinct("Order_ID").alias("Orders"),
        *[total(s).alias(k) for k, s in sums.items()],
    )


def _added(parts: DataFrame, keys: Sequence[str], sums: Iterable[str]) -> DataFrame:
    """Partial results as one; right when no order is in two of them."""
    return parts.groupBy(*keys).agg(F.sum("Orders").alias("Orders"), *[total(s).alias(s) for s in sums])


def daily_totals(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    daily = _grouped(lines, {"Date": "Order_Date_Only", "Platform": "Platform"}, _DAILY_SUMS, by)
    return daily.withColumn("AOV", ratio("GMV", "Orders"))


def add_daily(parts: DataFrame) -> DataFrame:
    return _added(parts, ["Date", "Platform"], _DAILY_SUMS).withColumn("AOV", ratio("GMV", "Orders"))


def with_growth(daily: DataFrame) -> DataFrame:
    """Growth against the k-th previous row of the same channel."""
    by_channel = Window.partitionBy("Platform").orderBy("Date")
    return daily.withColumns(
        {name: growth("GMV", F.lag("GMV", k).over(by_channel)) for name, k in GROWTH_LAGS.items()}
    )


def with_segments(daily: DataFrame) -> DataFrame:
    """GMV segment by the 20th and 80th percentile and AOV segment by the mean, over all channels.

    The daily table has one row per calendar day and channel, whatever the number of orders, so a window
    over all of it is small.
    """
    gmv = F.col("GMV").cast("double")
    return (
        daily.withColumns(
            {
                "_p20": F.percentile(gmv, F.lit(0.2)).over(whole_table()),
                "_p80": F.percentile(gmv, F.lit(0.8)).over(whole_table()),
                "_mean": F.avg("AOV").over(whole_table()),
            }
        )
        .withColumns(
            {
                "GMV_Segment": labels.gmv_segment("GMV", F.col("_p20"), F.col("_p80")),
                "AOV_Segment": labels.aov_segment("AOV", F.col("_mean")),
            }
        )
        .drop("_p20", "_p80", "_mean")
    )


def daily_sales(lines: DataFrame) -> DataFrame:
    return with_segments(with_growth(daily_totals(lines)))


def gmv_quantiles(daily: DataFrame) -> DataFrame:
    """The statistics behind the daily segments, as one row."""
    gmv = F.col("GMV").cast("double")
    return daily.agg(
        F.percentile(gmv, F.lit(0.2)).alias("P20_GMV"),
        F.median(gmv).alias("Median_GMV"),
        F.percentile(gmv, F.lit(0.8)).alias("P80_GMV"),
        F.avg("AOV").alias("Mean_AOV"),
        F.count("*").alias("Rows"),
        F.count_distinct("Date").alias("Days"),
    )


_PRODUCT_SUMS = {
    "Total_GMV": "Net_Sales",
    "Net_Revenue": "True_Net_Revenue",
    "Total_Qty": "Quantity",
    "Total_Discount": "Total_Discount",
}


def product_totals(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = {"Product_Name": "Product_Name", "SKU": "SKU", "Platform": "Platform"}
    if "SKU" not in lines.columns:
        lines = lines.withColumn("SKU", F.lit("N/A"))
    return _grouped(lines, keys, _PRODUCT_SUMS, by).withColumn("Avg_Price", ratio("Total_GMV", "Total_Qty"))


def add_products(parts: DataFrame) -> DataFrame:
    added = _added(parts, ["Product_Name", "SKU", "Platform"], _PRODUCT_SUMS)
    return added.withColumn("Avg_Price", ratio("Total_GMV", "Total_Qty"))


def product_medians(products: DataFrame) -> tuple[float, float, float]:
    """Median GMV and quantity of a staged product table, and its total GMV."""
    gmv, quantity = value_ranges(products, "Total_GMV"), value_ranges(products, "Total_Qty")
    return quantiles(gmv, [0.5])[0], quantiles(quantity, [0.5])[0], round(gmv.total, 4)


def product_master(lines: DataFrame) -> DataFrame:
    """Products with segment, share of GMV and risk."""
    return label_products(product_totals(lines))


def label_products(totals: DataFrame) -> DataFrame:
    """Product totals with segment, share of GMV and risk.

    The totals are staged because the medians and the grand total need all of them before any row can be
    labelled; the labelling itself is a narrow pass over the staged table.
    """
    totals = stage(totals, "products")
    median_gmv, median_quantity, grand_total = product_medians(totals)
    share = F.col("Total_GMV").cast("double") / F.nullif(F.lit(grand_total).cast("double"), F.lit(0.0)) * 100
    segment = labels.product_segment(
        "Total_GMV", "Total_Qty", F.lit(median_gmv).cast("double"), F.lit(median_quantity).cast("double")
    )
    return totals.withColumns(
        {"Product_Segment": segment, "GMV_Contribution_Pct": F.bround(share, 2)}
    ).withColumn("Risk_Status", labels.risk_status("Product_Segment", "GMV_Contribution_Pct"))


def ads_master(ads: DataFrame, min_clicks: int = 100) -> DataFrame:
    """Campaign totals with ratios of the sums and a health label."""
    keys = ["Ad_Name", "Ad_Type", "Status", "Platform"]
    sums = ["Impressions", "Clicks", "Orders", "Direct_Orders", "Products_Sold", "Sales", "Direct_Sales", "Ad_Cost"]
    return (
        ads.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*[total(c).alias(c) for c in sums])
        .withColumns(
            {
                "CTR": ratio("Clicks", "Impressions"),
                "Conversion_Rate": ratio("Orders", "Clicks"),
                "ROAS": ratio("Sales", "Ad_Cost"),
                "ACOS": ratio("Ad_Cost", "Sales"),
            }
        )
        .withColumn("Campaign_Health", labels.campaign_health(min_clicks))
    )


_GEO_SUMS = {"GMV": "Net_Sales", "Units_Sold": "Quantity"}


def geographic(lines: DataFrame) -> DataFrame:
    return _grouped(lines, {"Province": "Province", "Platform": "Platform"}, _GEO_SUMS)


def daily_geographic(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = {"Date": "Order_Date_Only", "Province": "Province", "Platform": "Platform"}
    return _grouped(lines, keys, _GEO_SUMS, by)


def add_geographic(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _added(parts, keys, _GEO_SUMS)
