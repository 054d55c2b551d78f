"""Live-stream and video performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio, total

_METRICS = ["GMV", "Orders", "Viewers", "Views", "Likes"]
# Marketplace reports name their figures otherwise; confirmed orders count.
_REPORTED = {
    "GMV": ("Sales_Confirmed", "Video_Sales_Confirmed"),
    "Orders": ("Orders_Confirmed", "Video_Orders_Confirmed"),
    "Viewers": ("Total_Viewers",),
    "Views": ("Total_Views",),
    "Likes": ("Total_Likes",),
    "Comments": ("Total_Comments",),
    "Shares": ("Total_Shares",),
}


def canonical(content: DataFrame) -> DataFrame:
    """Live or video rows of any channel with the same metric columns; a metric no report has is null."""
    found = {}
    for name, reported in _REPORTED.items():
        present = [F.col(c) for c in (name, *reported) if c in content.columns]
        found[name] = F.coalesce(*present) if present else F.lit(None).cast("double")
    content = content.withColumns(found)
    rate = ratio(F.col("Likes") + F.col("Comments") + F.col("Shares"), "Views", None)
    own = [F.col("Engagement_Rate")] if "Engagement_Rate" in content.columns else []
    return content.withColumn("Engagement_Rate", F.coalesce(*own, rate))


def content_performance(live: DataFrame, video: DataFrame) -> DataFrame:
    """Live and video reports under one another; videos have no peak concurrent users."""
    shared = ["Report_Date", "Content_Type", "Sales", "Orders", "Viewers", "PCU", "GPM"]
    lives = live.select(
        "Report_Date",
        F.lit("Live").alias("Content_Type"),
        F.col("Sales_Confirmed").alias("Sales"),
        F.col("Orders_Confirmed").alias("Orders"),
        F.col("Total_Viewers").alias("Viewers"),
        F.col("Peak_Concurrent_Users").alias("PCU"),
        F.col("GPM_Confirmed").alias("GPM"),
    )
    videos = video.select(
        "Report_Date",
        F.lit("Video").alias("Content_Type"),
        F.col("Video_Sales_Confirmed").alias("Sales"),
        F.col("Video_Orders_Confirmed").alias("Orders"),
        F.col("Total_Viewers").alias("Viewers"),
        F.lit(None).cast("double").alias("PCU"),
        F.col("Video_GPM_Confirmed").alias("GPM"),
    )
    return lives.select(*shared).unionByName(videos.select(*shared))


def platform_metrics(live: DataFrame, video: DataFrame) -> DataFrame:
    """Totals per channel for live sessions and videos, and both together."""
    tagged = canonical(live).withColumn("_kind", F.lit("live")).unionByName(
        canonical(video).withColumn("_kind", F.lit("video")), allowMissingColumns=True
    )
    is_live, is_video = F.col("_kind") == "live", F.col("_kind") == "video"

    def sum_if(condition, column):
        return total(F.when(condition, F.col(column)))

    return tagged.groupBy("Platform").agg(
        sum_if(is_live, "GMV").alias("live_gmv"),
        sum_if(is_live, "Orders").alias("live_orders"),
        sum_if(is_live, "Viewers").alias("live_viewers"),
        sum_if(is_live, "Likes").alias("live_likes"),
        F.count_if(is_live).alias("live_sessions"),
        sum_if(is_video, "GMV").alias("video_gmv"),
        sum_if(is_video, "Orders").alias("video_orders"),
        sum_if(is_video, "Views").alias("video_views"),
        F.count_if(is_video).alias("video_count"),
        total("GMV").alias("total_gmv"),
        total("Orders").alias("total_orders"),
    )


def video_summary(video: DataFrame) -> DataFrame:
    return canonical(video).groupBy("Platform").agg(
        *[total(c).alias(f"Total_{c}") for c in ("GMV", "Orders", "Views", "Likes")],
        F.avg("Engagement_Rate").alias("Avg_Engagement"),
    )


def top_creators(content: DataFrame, sums: Sequence[str], mean: str | None = None, n: int = 10) -> DataFrame:
    """The ``n`` creators with the largest GMV."""
    means = [F.avg(mean).alias(mean)] if mean else []
    return (
        content.filter(F.col("Creator").isNotNull())
        .groupBy("Creator")
        .agg(*[total(c).alias(c) for c in sums], *means)
        .orderBy(F.desc("GMV"), "Creator")
        .limit(n)
    )


def top_rows(content: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    return content.orderBy(F.desc(by), *ties).limit(n)


def daily_trend(content: DataFrame, values: Sequence[str] = ("GMV", "Orders", "Views")) -> DataFrame:
    """Sums per report date of the value columns that exist."""
    present = [c for c in values if c in content.columns]
    return (
        content.filter(F.col("Report_Date").isNotNull())
        .groupBy("Report_Date")
        .agg(*[total(c).alias(c) for c in present])
    )


def engagement_histogram(video: DataFrame, bins: int = 20) -> DataFrame:
    """Number of videos in equal-width bins of the engagement rate between its minimum and maximum.

    The limits are one row and come as a scalar subquery; the maximum itself belongs to the last bin. The
    videos are read twice, so they should be a stored table.
    """
    value = F.col("Engagement_Rate")
    limits = video.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("limits"))
    limit = limits.scalar()
    width = (limit.getField("high") - limit.getField("low")) / bins
    number = F.when(width > 0, F.least(F.floor((value - limit.getField("low")) / width), F.lit(bins - 1))).otherwise(0)
    return (
        video.filter(value.isNotNull())
        .select(
            number.cast("int").alias("Bin"),
            (limit.getField("low") + number * width).alias("Bin_Start"),
            (limit.getField("low") + (number + 1) * width).alias("Bin_End"),
        )
        .groupBy("Bin", "Bin_Start", "Bin_End")
        .agg(F.count("*").alias("Videos"))
    )


def total_per_content(live: DataFrame) -> DataFrame:
    """Totals of the live sessions per channel."""
    return canonical(live).groupBy("Platform").agg(*[total(c).alias(f"Total_{c}") for c in _METRICS])


