"""Periods relative to the newest day, comparisons and rankings inside a period."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import as_column, change_pct, ratio, total, whole_table
from tradewind.operators import labels
from tradewind.operators.masters import product_medians
from tradewind.session import stage


def bounds(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Earliest and latest date over several sources, as one row."""
    parts = [
        df.agg(F.min(c).cast("date").alias("Min_Date"), F.max(c).cast("date").alias("Max_Date")) for df, c in columns
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(F.min("Min_Date").alias("Min_Date"), F.max("Max_Date").alias("Max_Date"))


def period_limits(first, last) -> dict[str, tuple[Column, Column]]:
    """Start and end of every named period, from the first and last day of the data."""
    first, last = as_column(first), as_column(last)
    january = F.trunc(last, "year")

    def month(number: int) -> Column:
        return F.add_months(january, number - 1)

    def back(days: int) -> tuple[Column, Column]:
        return F.date_sub(last, days), last

    return {
        "Today": (last, last),
        "This Week": back(7),
        "This Month": (F.trunc(last, "month"), last),
        "This Year": (january, last),
        "Q1": (january, F.least(F.date_sub(month(4), 1), last)),
        "Q2": (month(4), F.least(F.date_sub(month(7), 1), last)),
        "Q3": (F.greatest(month(7), first), F.least(F.date_sub(month(10), 1), last)),
        "Q4": (F.greatest(month(10), first), last),
        "Last 7 Days": back(7),
        "Last 30 Days": back(30),
        "Last 90 Days": back(90),
        "Last 12 Months": back(365),
        "All Time": (first, last),
    }


_IGNORED_WHEN_EMPTY = ["Q3", "Q4"]


def named_periods(limits: DataFrame) -> DataFrame:
    """All named periods of a one-row bounds frame; a third or fourth quarter not yet begun is left out."""
    rows = [
        F.struct(F.lit(name).alias("Period"), start.alias("Start_Date"), end.alias("End_Date"))
        for name, (start, end) in period_limits("Min_Date", "Max_Date").items()
    ]
    periods = limits.select(F.inline(F.array(*rows)))
    begun = F.col("Start_Date") <= F.col("End_Date")
    return periods.filter(begun | ~F.col("Period").isin(_IGNORED_WHEN_EMPTY))


def resolve_period(name: str, limits: DataFrame) -> tuple[date, date] | None:
    """One named period as two dates, so that it can be pushed into a scan as literals."""
    row = named_periods(limits).filter(F.col("Period") == name).first()
    return (row["Start_Date"], row["End_Date"]) if row else None


def in_period(df: DataFrame, column: str, start: date, end: date, platform: str | None = None) -> DataFrame:
    """Rows of whole days from ``start`` to ``end``; works on dates and timestamps without casting them."""
    kept = df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end + timedelta(days=1))))
    return kept.filter(F.col("Platform") == platform) if platform else kept


def previous_period(start: date, end: date) -> tuple[date, date]:
    """The period of the same length that ends the day before ``start``."""
    length = (end - start).days + 1
    return start - timedelta(days=length), start - timedelta(days=1)


def hero_comparison(daily: DataFrame, start: date, end: date, platform: str | None = None) -> DataFrame:
    """Totals of a period, of the one before, and the change in percent.

    There is no comparison when the previous period has no rows.
    """
    before, before_end = previous_period(start, end)
    chosen = F.col("Platform") == platform if platform else F.lit(True)
    now = chosen & F.col("Date").between(F.lit(start), F.lit(end))
    then = chosen & F.col("Date").between(F.lit(before), F.lit(before_end))

    def sum_if(condition: Column, column: str) -> Column:
        return total(F.when(condition, F.col(column))).cast("double")

    def mean(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, F.col("AOV"))), F.lit(0.0))

    sums = ["GMV", "Orders", "Net_Revenue", "Units_Sold"]
    # A day of the previous period is itself proof that the data reach back to it.
    row = daily.filter(F.col("Date").between(F.lit(before), F.lit(end))).agg(
        *[sum_if(now, c).alias(f"Current_{c}") for c in sums],
        mean(now).alias("Current_AOV"),
        *[sum_if(then, c).alias(f"Previous_{c}") for c in sums],
        mean(then).alias("Previous_AOV"),
        (F.count_if(then) > 0).alias("Has_Previous"),
    )
    changes = {
        f"{c}_Change_Pct": F.when(
            F.col("Has_Previous") & (F.col(f"Previous_{c}") > 0), change_pct(f"Current_{c}", f"Previous_{c}")
        )
        for c in ["GMV", "Orders", "AOV", "Net_Revenue"]
    }
    return row.withColumns(changes).withColumn("Net_Margin_Pct", ratio("Current_Net_Revenue", "Current_GMV") * 100)


def trend_vs_previous(daily: DataFrame, start: date, end: date) -> DataFrame:
    """GMV per day and channel beside the previous period's, shifted to the same days. One scan, no join."""
    before, _ = previous_period(start, end)
    length = (end - start).days + 1
    current = F.col("Date") >= F.lit(start)
    day = F.when(current, F.col("Date")).otherwise(F.date_add("Date", length))
    return (
        daily.filter(F.col("Date").between(F.lit(before), F.lit(end)))
        .groupBy(day.alias("Date"), "Platform")
        .agg(
            F.sum(F.when(current, F.col("GMV"))).alias("Current_GMV"),
            F.sum(F.when(~current, F.col("GMV"))).alias("Previous_GMV"),
        )
    )


def platform_breakdown(daily: DataFrame) -> DataFrame:
    """Totals, date range and shares per channel."""
    totals = daily.groupBy("Platform").agg(
        *[total(c).alias(c) for c in ("GMV", "Orders", "Net_Revenue", "Units_Sold")],
        F.min("Date").alias("Min_Date"),
        F.max("Date").alias("Max_Date"),
        F.count("Date").alias("Days"),
    )
    return totals.withColumns(
        {f"{c}_Share_Pct": ratio(c, F.sum(c).over(whole_table())) * 100 for c in ("GMV", "Orders", "Net_Revenue")}
    )


def products_in_period(lines: DataFrame, start: date, end: date, platform: str | None = None) -> DataFrame:
    """Products sold in a period with segments that count the median as high."""
    sold = in_period(lines, "Order_Date", start, end, platform).dropna(subset=["Product_Name", "SKU"])
    totals = sold.groupBy("Product_Name", "SKU").agg(
        total("Net_Sales").alias("Total_GMV"),
        total("Quantity").alias("Total_Qty"),
        F.count_distinct("Order_ID").alias("Orders"),
    )
    totals = stage(totals, "period-products")
    median_gmv, median_quantity, _ = product_medians(totals)
    segment = labels.product_segment(
        "Total_GMV",
        "Total_Qty",
        F.lit(median_gmv).cast("double"),
        F.lit(median_quantity).cast("double"),
        inclusive=True,
    )
    return totals.withColumns({"Product_Segment": segment, "Avg_Price": ratio("Total_GMV", "Total_Qty")})


def period_product_segments(products: DataFrame) -> DataFrame:
    return products.groupBy(F.col("Product_Segment").alias("Segment")).agg(
        F.count("Product_Name").alias("Products"),
        total("Total_GMV").alias("GMV"),
        total("Total_Qty").alias("Units"),
    )


def largest_products(products: DataFrame, n: int) -> DataFrame:
    return products.orderBy(F.desc("Total_GMV"), "Product_Name", "SKU").limit(n)


def smallest_products(products: DataFrame, n: int) -> DataFrame:
    return products.orderBy("Total_GMV", "Product_Name", "SKU").limit(n)


def provinces_in_period(daily_geo: DataFrame, start: date, end: date, platform: str | None = None) -> DataFrame:
    return (
        in_period(daily_geo, "Date", start, end, platform)
        .groupBy("Province")
        .agg(*[total(c).alias(c) for c in ("GMV", "Orders", "Units_Sold")])
    )


def province_concentration(provinces: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` provinces by GMV with the number of provinces and the shares of the first and first five."""
    ranked = provinces.withColumn(
        "Position", F.row_number().over(Window.orderBy(F.desc("GMV"), "Province"))
    )
    everything = F.sum("GMV").over(whole_table())

    def share(first: int) -> Column:
        part = F.sum(F.when(F.col("Position") <= first, F.col("GMV"))).over(whole_table())
        return ratio(part, everything) * 100

    return ranked.withColumns(
        {"Provinces": F.count("*").over(whole_table()), "Top1_Share_Pct": share(1), "Top5_Share_Pct": share(5)}
    ).filter(F.col("Position") <= top)


def last_day_growth(daily: DataFrame) -> DataFrame:
    """GMV and growth of each channel's last day."""
    columns = ["Date", "GMV", "DoD_GMV_Growth", "WoW_GMV_Growth", "MoM_GMV_Growth"]
    return (
        daily.groupBy("Platform")
        .agg(F.max_by(F.struct(*columns), "Date").alias("last"))
        .select("Platform", "last.*")
    )


def recent_days(daily: DataFrame, n: int = 14) -> DataFrame:
    """The newest ``n`` rows of the daily table."""
    return daily.orderBy(F.desc("Date"), F.desc("Platform")).limit(n)
