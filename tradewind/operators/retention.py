"""Customers over time: new against returning, cohorts, churn, lifetime value, migration between segments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio, total
from tradewind.operators import customers
from tradewind.session import stage


def monthly_purchases(lines: DataFrame, customer: str = "Buyer_Username") -> DataFrame:
    """``Customer_ID``, ``Month`` with distinct orders, GMV and net revenue; the aggregate all of this module reads.

    An order counts in the month of each of its lines. Lines without customer or date are left out."""
    month = F.trunc("Order_Date_Only", "month").alias("Month")
    known = lines.filter(F.col(customer).isNotNull() & (F.col(customer) != "") & F.col("Order_Date_Only").isNotNull())
    return known.groupBy(F.col(customer).alias("Customer_ID"), month).agg(
        F.count_distinct("Order_ID").alias("Orders"), total("Net_Sales").alias("GMV"), total("True_Net_Revenue").alias("Net_Revenue")
    )


def first_purchases(purchases: DataFrame) -> DataFrame:
    """The cohort of every customer: the month of the first purchase. Of several such tables the earliest month counts."""
    return purchases.groupBy("Customer_ID").agg(F.min("Month").alias("Cohort"))


def with_cohort(purchases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Purchases with the customer's cohort; ``known`` are cohorts stored by earlier runs, which count as well."""
    firsts = first_purchases(purchases)
    if known is not None:
        firsts = firsts.unionByName(known.select("Customer_ID", "Cohort")).groupBy("Customer_ID").agg(F.min("Cohort").alias("Cohort"))
    return purchases.join(firsts, "Customer_ID")


def new_and_returning(purchases: DataFrame) -> DataFrame:
    """Customers, orders and GMV per month, of those who bought for the first time and of those who came back. ``purchases`` have
    their cohort."""
    kind = F.when(F.col("Month") == F.col("Cohort"), "new").otherwise("returning").alias("Kind")
    return purchases.groupBy("Month", kind).agg(
        F.count("*").alias("Customers"), F.sum("Orders").alias("Orders"), total("GMV").alias("GMV")
    )


def _months_between(later, earlier) -> Column:
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def cohort_triangle(purchases: DataFrame) -> DataFrame:
    """Per cohort and age in months: customers who bought, their share of the cohort, orders, GMV, and GMV to date per customer of
    the cohort. Ages in which nobody bought have no row."""
    grouped = purchases.groupBy("Cohort", _months_between("Month", "Cohort").alias("Age")).agg(
        F.count("*").alias("Customers"), F.sum("Orders").alias("Orders"), total("GMV").alias("GMV"), total("Net_Revenue").alias("Net_Revenue")
    )
    by_age = Window.partitionBy("Cohort").orderBy("Age").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # All customers of a cohort buy at age 0.
    size = F.first("Customers").over(by_age)
    return grouped.withColumns(
        {
            "Cohort_Size": size,
            "Retention": ratio("Customers", size),
            "GMV_To_Date": F.sum("GMV").over(by_age) / size,
            "Net_Revenue_To_Date": F.sum("Net_Revenue").over(by_age) / size,
        }
    )


def churn(purchases: DataFrame, within: int = 1) -> DataFrame:
    """Per month: customers who bought, those of them who did not buy again in the ``within`` months after it, and their share. Only
    months whose ``within`` following months are in the data."""
    months = purchases.select("Customer_ID", "Month").distinct()
    after = F.lead("Month").over(Window.partitionBy("Customer_ID").orderBy("Month"))
    gone = F.coalesce(_months_between(after, "Month") > within, F.lit(True))
    last = purchases.agg(F.max("Month")).scalar()
    active = months.withColumn("_gone", gone).filter(F.add_months("Month", within) <= last)
    rates = active.groupBy("Month").agg(F.count("*").alias("Active"), F.count_if("_gone").alias("Churned"))
    return rates.withColumn("Churn_Rate", ratio("Churned", "Active"))


def ltv_to_cac(triangle: DataFrame, spend: DataFrame) -> DataFrame:
    """Per cohort: lifetime value (net revenue to date per customer), acquisition cost (ad spend of the cohort's month per new customer)
    and their ratio, null without spend. ``spend`` has ``Month`` and ``Ad_Spend``."""
    value = triangle.groupBy("Cohort").agg(F.max("Cohort_Size").alias("New_Customers"), F.max_by("Net_Revenue_To_Date", "Age").alias("LTV"))
    paid = spend.groupBy(F.col("Month").alias("Cohort")).agg(total("Ad_Spend").alias("Ad_Spend"))
    found = value.join(paid, "Cohort", "left").withColumn("CAC", ratio(F.coalesce("Ad_Spend", F.lit(0.0)), "New_Customers"))
    return found.withColumn("LTV_CAC", F.when(F.col("CAC") > 0, F.col("LTV") / F.col("CAC")))


def snapshots(lines: DataFrame, moments: Sequence[date], customer: str = "Buyer_Username") -> list[DataFrame]:
    """Recency, frequency and revenue per customer as they were on the morning of each day, from one pass over the lines.

    The lines are added up by order first, so that distinct orders up to each day are plain conditional counts."""
    known = lines.filter(F.col(customer).isNotNull() & (F.col(customer) != "") & (F.col("Order_Date") < F.lit(max(moments))))
    orders = known.groupBy(F.col(customer).alias("Customer_ID"), "Order_ID").agg(
        *[F.max(F.when(F.col("Order_Date") < F.lit(m), F.col("Order_Date"))).alias(f"_last{i}") for i, m in enumerate(moments)],
        *[F.sum(F.when(F.col("Order_Date") < F.lit(m), F.col("Net_Sales"))).alias(f"_sum{i}") for i, m in enumerate(moments)],
    )
    grouped = orders.groupBy("Customer_ID").agg(
        *[F.max(f"_last{i}").alias(f"_last{i}") for i in range(len(moments))],
        *[F.count(f"_last{i}").alias(f"_n{i}") for i in range(len(moments))],
        *[total(f"_sum{i}").alias(f"_sum{i}") for i in range(len(moments))],
    )
    stored = stage(grouped, "snapshots")
    return [
        stored.filter(F.col(f"_n{i}") > 0).select(
            "Customer_ID",
            F.timestamp_diff("DAY", F.col(f"_last{i}"), F.lit(m).cast("timestamp")).alias("Recency"),
            F.col(f"_n{i}").alias("Frequency"),
            F.col(f"_sum{i}").alias("Monetary"),
        )
        for i, m in enumerate(moments)
    ]


def segment_moves(lines: DataFrame, before: date, after: date, customer: str = "Buyer_Username") -> DataFrame:
    """Customers with their segment on two days; null where a customer had not bought yet."""
    first, second = (
        customers.rfm_segments(customers.rfm_scores(base)).select("Customer_ID", F.col("Segment").alias(name))
        for base, name in zip(snapshots(lines, [before, after], customer), ("Segment_Before", "Segment_After"))
    )
    return first.join(second, "Customer_ID", "full")


def segment_migration(moves: DataFrame) -> DataFrame:
    """How many customers went from which segment to which, and their share of the segment they left; ``none`` stands for those who
    had not bought yet."""
    names = [F.coalesce(c, F.lit("none")).alias(c) for c in ("Segment_Before", "Segment_After")]
    counted = moves.groupBy(*names).agg(F.count("*").alias("Customers"))
    return counted.withColumn("Share", ratio("Customers", F.sum("Customers").over(Window.partitionBy("Segment_Before"))))
