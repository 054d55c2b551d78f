"""Ads, live-stream and video queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import ADS, ADS_RAW, CONTENT, ads, content
from checks.base import Check
from tradewind.operators import content as contents
from tradewind.operators import masters, promotion
from tradewind.plans import named
from tradewind.session import stage

_ADS = (ADS_RAW, ADS)
_CONTENT = (CONTENT,)
_CAMPAIGN = "Impressions:l Clicks:l Orders:l"

_LIST = """(SELECT *, CASE WHEN "ROAS" >= 5 THEN '🚀 Excellent (ROAS ≥ 5)' WHEN "ROAS" >= 3 THEN '✅ Good (ROAS 3-5)'
    WHEN "ROAS" >= 1 THEN '⚠️ Break-even (ROAS 1-3)' WHEN "Orders" = 0 AND "Clicks" > 50 THEN '🔴 Bleeding (No sales)'
    WHEN "Orders" > 0 THEN '📊 Needs Monitoring' END AS "Health_List" FROM ads_master)"""


def _master(spark, folder):
    return masters.ads_master(ads(spark, folder))


def _overview(spark, folder, kind):
    """Marketplace reports of a day: totals over its sessions or videos."""
    prefix = "" if kind == "live" else "Video_"
    reports = content(spark, folder, kind).filter(F.col("Platform") == "marketplace").groupBy("Report_Date").agg(
        F.sum("GMV").cast("double").alias(f"{prefix}Sales_Confirmed"),
        F.sum("Orders").cast("double").alias(f"{prefix}Orders_Confirmed"),
        F.sum("Viewers").cast("double").alias("Total_Viewers"),
        F.max("Viewers").cast("double").alias("Peak_Concurrent_Users"),
        *([] if kind == "live" else [F.sum(c).cast("double").alias(f"Total_{c}") for c in ("Views", "Likes", "Comments", "Shares")]),
    )
    gpm = F.col(f"{prefix}Sales_Confirmed") * 1000 / F.nullif(F.col("Total_Viewers"), F.lit(0.0))
    return reports.withColumn(f"{prefix}GPM_Confirmed", gpm)


def _all_channels(spark, folder, kind):
    """The other channels' rows as they are, the marketplace's as overview reports."""
    others = content(spark, folder, kind).filter(F.col("Platform") != "marketplace")
    reports = _overview(spark, folder, kind).withColumn("Platform", F.lit("marketplace"))
    return others.unionByName(reports, allowMissingColumns=True)


def _overview_sql(kind: str, label: str, peak: str) -> str:
    return f"""SELECT "Report_Date", '{label}' AS "Content_Type", CAST(sum("GMV") AS DOUBLE) AS "Sales", sum("Orders") AS "Orders",
      sum("Viewers") AS "Viewers", {peak} AS "PCU", CAST(sum("GMV") AS DOUBLE) * 1000 / nullif(sum("Viewers"), 0) AS "GPM"
      FROM {kind} WHERE "Platform" = 'marketplace' GROUP BY 1"""


CHECKS = [
    Check(
        "clean_ads",
        f"Ad_Name:s Ad_Type:s Status:s Platform:s {_CAMPAIGN} Direct_Orders:l Products_Sold:l Sales:f4 Direct_Sales:f4 Ad_Cost:f4 "
        "CTR:f6 Conversion_Rate:f6 ROAS:f6 ACOS:f6",
        ads,
        "SELECT * FROM ads_clean",
        _ADS,
    ),
    Check(
        "ads_master",
        f"Ad_Name:s Ad_Type:s Status:s Platform:s {_CAMPAIGN} Direct_Orders:l Products_Sold:l Sales:f4 Direct_Sales:f4 Ad_Cost:f4 "
        "CTR:f6 Conversion_Rate:f6 ROAS:f6 ACOS:f6 Campaign_Health:s",
        _master,
        "SELECT * FROM ads_master",
        _ADS,
    ),
    Check(
        "ads_summary",
        "Total_Impressions:l Total_Clicks:l Total_Orders:l Total_Sales:f4 Total_Ad_Spend:f4 Blended_ROAS:f6 ACOS_Pct:f4 CTR_Pct:f4",
        lambda s, f: named.ads_summary(_master(s, f)),
        """SELECT sum("Impressions") AS "Total_Impressions", sum("Clicks") AS "Total_Clicks", sum("Orders") AS "Total_Orders",
             sum("Sales") AS "Total_Sales", sum("Ad_Cost") AS "Total_Ad_Spend",
             CAST(sum("Sales") AS DOUBLE) / nullif(CAST(sum("Ad_Cost") AS DOUBLE), 0) AS "Blended_ROAS",
             CAST(sum("Ad_Cost") AS DOUBLE) / nullif(CAST(sum("Sales") AS DOUBLE), 0) * 100 AS "ACOS_Pct",
             CAST(sum("Clicks") AS DOUBLE) / nullif(CAST(sum("Impressions") AS DOUBLE), 0) * 100 AS "CTR_Pct" FROM ads_master""",
        _ADS,
    ),
    Check(
        "top_campaigns",
        f"Ad_Name:s Ad_Type:s Status:s {_CAMPAIGN} Sales:f4 Ad_Cost:f4 ROAS:f6 ACOS:f6 Campaign_Health:s",
        lambda s, f: named.top_campaigns(_master(s, f), running="running"),
        "SELECT * FROM ads_master WHERE \"Status\" = 'running' ORDER BY \"ROAS\" DESC, \"Ad_Name\", \"Ad_Type\" LIMIT 15",
        _ADS,
    ),
    Check(
        "bleeding_campaigns",
        f"Ad_Name:s Ad_Type:s {_CAMPAIGN} Sales:f4 Ad_Cost:f4 ROAS:f6 Campaign_Health:s",
        lambda s, f: named.bleeding_campaigns(_master(s, f)),
        'SELECT * FROM ads_master WHERE "ROAS" < 1 OR ("Orders" = 0 AND "Clicks" > 100)',
        _ADS,
    ),
    Check(
        "campaign_health_counts",
        "Health_List:s Campaigns:l Spend:f4",
        lambda s, f: named.campaign_health_counts(_master(s, f)),
        f'SELECT "Health_List", count(*) AS "Campaigns", sum("Ad_Cost") AS "Spend" FROM {_LIST} WHERE "Health_List" IS NOT NULL GROUP BY 1',
        _ADS,
    ),
    Check(
        "campaign_health_lists",
        f"Health_List:s Ad_Name:s Ad_Type:s Status:s {_CAMPAIGN} Sales:f4 Ad_Cost:f4 ROAS:f6 CTR:f6",
        lambda s, f: named.campaign_health_lists(_master(s, f)),
        f'SELECT * FROM {_LIST} WHERE "Health_List" IS NOT NULL',
        _ADS,
    ),
    Check(
        "engagement_rate",
        "Creator:s Report_Date:d Content_Kind:s Views:l Engagement_Rate:f6 Likes_Only_Rate:f6 Rate_Or_Null:f6",
        lambda s, f: content(s, f).withColumns(
            {
                "Likes_Only_Rate": promotion.engagement_rate(comments=F.lit(0), shares=F.lit(0)),
                "Rate_Or_Null": promotion.engagement_rate(empty=None),
            }
        ),
        """SELECT *, CASE WHEN "Views" > 0 THEN "Likes" / "Views" ELSE 0 END AS "Likes_Only_Rate",
             CASE WHEN "Views" > 0 THEN "Engagement_Rate" END AS "Rate_Or_Null" FROM content""",
        _CONTENT,
    ),
    Check(
        "content_performance",
        "Report_Date:d Content_Type:s Sales:f4 Orders:l Viewers:l PCU:f4 GPM:f4",
        lambda s, f: named.content_performance(_overview(s, f, "live"), _overview(s, f, "video")),
        f"{_overview_sql('live', 'Live', 'max(\"Viewers\")')} UNION ALL {_overview_sql('video', 'Video', 'NULL')}",
        _CONTENT,
    ),
    Check(
        "content_platform_metrics",
        "Platform:s live_gmv:f4 live_orders:l live_viewers:l live_likes:l live_sessions:l video_gmv:f4 video_orders:l video_views:l "
        "video_count:l total_gmv:f4 total_orders:l",
        lambda s, f: contents.platform_metrics(_all_channels(s, f, "live"), _all_channels(s, f, "video")),
        """SELECT "Platform", coalesce(sum("GMV") FILTER (k = 'live'), 0) AS live_gmv, coalesce(sum("Orders") FILTER (k = 'live'), 0) AS live_orders,
             coalesce(sum("Viewers") FILTER (k = 'live'), 0) AS live_viewers,
             coalesce(sum("Likes") FILTER (k = 'live' AND "Platform" <> 'marketplace'), 0) AS live_likes,
             CASE WHEN "Platform" = 'marketplace' THEN count(DISTINCT "Report_Date") FILTER (k = 'live') ELSE count(*) FILTER (k = 'live') END AS live_sessions,
             coalesce(sum("GMV") FILTER (k = 'video'), 0) AS video_gmv,
             coalesce(sum("Orders") FILTER (k = 'video'), 0) AS video_orders, coalesce(sum("Views") FILTER (k = 'video'), 0) AS video_views,
             CASE WHEN "Platform" = 'marketplace' THEN count(DISTINCT "Report_Date") FILTER (k = 'video') ELSE count(*) FILTER (k = 'video') END AS video_count,
             sum("GMV") AS total_gmv, sum("Orders") AS total_orders
           FROM (SELECT *, "Content_Kind" AS k FROM content) GROUP BY 1""",
        _CONTENT,
    ),
    Check(
        "video_summary",
        "Platform:s Total_GMV:f4 Total_Orders:l Total_Views:l Total_Likes:l Avg_Engagement:f6",
        lambda s, f: contents.video_summary(_all_channels(s, f, "video")),
        """SELECT "Platform", sum("GMV") AS "Total_GMV", sum("Orders") AS "Total_Orders", sum("Views") AS "Total_Views",
             sum("Likes") AS "Total_Likes", avg("Engagement_Rate") AS "Avg_Engagement" FROM video WHERE "Platform" <> 'marketplace' GROUP BY 1
           UNION ALL SELECT 'marketplace', sum(g), sum(o), sum(v), sum(l), avg(r) FROM (
             SELECT sum("GMV") AS g, sum("Orders") AS o, sum("Views") AS v, sum("Likes") AS l,
               CASE WHEN sum("Views") > 0 THEN (sum("Likes") + sum("Comments") + sum("Shares")) / sum("Views") END AS r
             FROM video WHERE "Platform" = 'marketplace' GROUP BY "Report_Date")""",
        _CONTENT,
    ),
    Check(
        "live_summary",
        "Platform:s Total_GMV:f4 Total_Orders:l Total_Viewers:l Total_Likes:l",
        lambda s, f: contents.total_per_content(_all_channels(s, f, "live")),
        """SELECT "Platform", sum("GMV") AS "Total_GMV", sum("Orders") AS "Total_Orders", sum("Viewers") AS "Total_Viewers",
             CASE WHEN "Platform" <> 'marketplace' THEN sum("Likes") ELSE 0 END AS "Total_Likes" FROM live GROUP BY 1""",
        _CONTENT,
    ),
    Check(
        "top_live_creators",
        "Creator:s GMV:f4 Orders:l Viewers:l Likes:l",
        lambda s, f: contents.top_creators(content(s, f, "live"), ["GMV", "Orders", "Viewers", "Likes"]),
        """SELECT "Creator", sum("GMV") AS "GMV", sum("Orders") AS "Orders", sum("Viewers") AS "Viewers", sum("Likes") AS "Likes"
           FROM live GROUP BY 1 ORDER BY sum(live."GMV") DESC, "Creator" LIMIT 10""",
        _CONTENT,
    ),
    Check(
        "top_video_creators",
        "Creator:s GMV:f4 Orders:l Views:l Engagement_Rate:f6",
        lambda s, f: contents.top_creators(content(s, f, "video"), ["GMV", "Orders", "Views"], mean="Engagement_Rate"),
        """SELECT "Creator", sum("GMV") AS "GMV", sum("Orders") AS "Orders", sum("Views") AS "Views", avg("Engagement_Rate") AS "Engagement_Rate"
           FROM video GROUP BY 1 ORDER BY sum(video."GMV") DESC, "Creator" LIMIT 10""",
        _CONTENT,
    ),
    Check(
        "top_live_sessions",
        "Creator:s Report_Date:d GMV:f4 Orders:l Viewers:l",
        lambda s, f: contents.top_rows(content(s, f, "live"), "GMV", 10, ["Creator", "Report_Date"]),
        'SELECT * FROM live ORDER BY "GMV" DESC, "Creator", "Report_Date" LIMIT 10',
        _CONTENT,
    ),
    Check(
        "top_videos",
        "Creator:s Report_Date:d GMV:f4 Orders:l Views:l Engagement_Rate:f6",
        lambda s, f: contents.top_rows(content(s, f, "video"), "GMV", 10, ["Creator", "Report_Date"]),
        'SELECT * FROM video ORDER BY "GMV" DESC, "Creator", "Report_Date" LIMIT 10',
        _CONTENT,
    ),
    Check(
        "top_engagement",
        "Creator:s Report_Date:d Views:l Likes:l Comments:l Engagement_Rate:f6",
        lambda s, f: contents.top_rows(content(s, f, "video"), "Engagement_Rate", 15, ["Creator", "Report_Date"]),
        'SELECT * FROM video ORDER BY "Engagement_Rate" DESC, "Creator", "Report_Date" LIMIT 15',
        _CONTENT,
    ),
    Check(
        "content_daily_trend",
        "Report_Date:d GMV:f4 Orders:l Views:l",
        lambda s, f: contents.daily_trend(content(s, f)),
        'SELECT "Report_Date", sum("GMV") AS "GMV", sum("Orders") AS "Orders", sum("Views") AS "Views" FROM content GROUP BY 1',
        _CONTENT,
    ),
    Check(
        "engagement_histogram",
        "Bin:i Bin_Start:f6 Bin_End:f6 Videos:l",
        lambda s, f: contents.engagement_histogram(stage(content(s, f, "video"), "videos")),
        """SELECT b AS "Bin", lo + b * w AS "Bin_Start", lo + (b + 1) * w AS "Bin_End", count(*) AS "Videos"
           FROM (SELECT lo, w, least(floor(("Engagement_Rate" - lo) / w), 19) AS b
                 FROM video, (SELECT min("Engagement_Rate") AS lo, (max("Engagement_Rate") - min("Engagement_Rate")) / 20 AS w FROM video))
           GROUP BY 1, 2, 3""",
        _CONTENT,
    ),
]
