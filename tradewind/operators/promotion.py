"""Cleaning of the ads, live-stream and video exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import parsing
from tradewind.functions.numbers import as_column, ratio
from tradewind.operators.channels import converted, with_missing
from tradewind.sources import layouts


def with_ad_ratios(ads: DataFrame) -> DataFrame:
    """ROAS where there is a cost and ACOS where there are sales; else the exported value is kept."""
    sales, cost = F.col("Sales").cast("double"), F.col("Ad_Cost").cast("double")
    return ads.withColumns(
        {
            "ROAS": F.when(cost > 0, sales / cost).otherwise(F.col("ROAS").cast("double")),
            "ACOS": F.when(sales > 0, cost / sales).otherwise(F.col("ACOS").cast("double")),
        }
    )


def clean_ads(raw: DataFrame) -> DataFrame:
    df = raw.withColumnsRenamed(layouts.ADS)
    df = converted(df, layouts.ADS_NUMBERS, parsing.numeric)
    df = converted(df, layouts.ADS_PERCENTS, parsing.percent)
    df = converted(df, ["ROAS"], parsing.numeric)
    return with_ad_ratios(df).withColumn("Platform", F.lit("marketplace"))


def engagement_rate(likes="Likes", comments="Comments", shares="Shares", views="Views", empty=0.0) -> Column:
    """(likes + comments + shares) / views; ``empty`` where there are no views.

    Pass ``comments=F.lit(0), shares=F.lit(0)`` for a rate of likes only.
    """
    return ratio(as_column(likes) + as_column(comments) + as_column(shares), views, empty)


def _overview(raw: DataFrame, names: Sequence[tuple[str, str]], as_text: Sequence[str]) -> DataFrame:
    numbers = [name for _, name in names if name not in as_text]
    raw = with_missing(raw, as_text, F.lit(None).cast("string"))
    return converted(raw, numbers, parsing.currency).withColumn("Platform", F.lit("marketplace"))


def clean_live_overview(raw: DataFrame) -> DataFrame:
    df = _overview(raw, layouts.LIVE_OVERVIEW, ["Report_Period", "Total_Live_Duration"])
    seconds = F.coalesce(parsing.duration_thai("Total_Live_Duration"), F.lit(0)).cast("double")
    return df.withColumns({"Live_Duration_Seconds": seconds, "Live_Duration_Hours": seconds / 3600})


def clean_video_overview(raw: DataFrame) -> DataFrame:
    return _overview(raw, layouts.VIDEO_OVERVIEW, ["Report_Period"])


def clean_social_live(raw: DataFrame) -> DataFrame:
    df = converted(raw.withColumnsRenamed(layouts.SOCIAL_LIVE), layouts.SOCIAL_LIVE_NUMBERS, parsing.currency)
    if "Duration" in df.columns:
        seconds = F.coalesce(parsing.duration_short("Duration"), F.lit(0))
        df = df.withColumns({"Duration_Seconds": seconds, "Duration_Minutes": seconds / 60})
    present = [c for c in layouts.SOCIAL_LIVE_PERCENTS if c in df.columns]
    return converted(df, present, parsing.percent).withColumns(
        {"Engagement_Rate": engagement_rate(empty=None), "Platform": F.lit("social")}
    )


def clean_social_video(raw: DataFrame) -> DataFrame:
    """Videos with canonical column names (the reader has already mapped each of the two layouts)."""
    df = converted(raw, layouts.SOCIAL_VIDEO_NUMBERS, parsing.currency)
    df = converted(df, layouts.SOCIAL_VIDEO_PERCENTS, parsing.percent)
    df = with_missing(df, ["Post_Time", "Post_Date"], F.lit(None).cast("string"))
    posted = F.coalesce(parsing.timestamp_iso("Post_Time"), parsing.timestamp_iso("Post_Date"))
    return df.withColumns(
        {
            "Post_Date": posted.cast("date"),
            "Engagement_Rate": engagement_rate(),
            "Platform": F.lit("social"),
        }
    )
