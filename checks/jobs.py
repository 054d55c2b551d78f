"""Readers of raw exports, refresh jobs, sinks and streaming, on exports written from the benchmark tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import exports
from checks.adapters import ADS, ADS_RAW, ALL, CONTENT, DAILY, DAILY_GEO, GEO, LINES, PRODUCTS, RAW_LINES
from checks.adapters import ads, ads_raw, content, order_lines, table
from checks.base import Check
from checks.customers import _RFM
from checks.orders import _all_orders, _MASTER_SUMS
from checks.promotion import _overview, _overview_sql
from tradewind.operators import channels, masters, promotion, versions
from tradewind.plans import months, refresh, sinks
from tradewind.session import stage, staged, staging_path
from tradewind.sources import delimited, files, layouts, tables
from tradewind.streaming import ingest

_LINES = (RAW_LINES, LINES)


def _new_folder(spark, name):
    return staging_path(spark, name)


def _src_orders(spark, folder):
    target = _new_folder(spark, "export-orders")
    exports.marketplace_orders(order_lines(spark, folder, *ALL, valid=False), target)
    raw = delimited.read_csv(spark, target, exports.FILES)
    return channels.clean_marketplace_orders(raw, keywords=["ring"])


def _src_social_orders(spark, folder):
    target = _new_folder(spark, "export-social")
    exports.social_orders(order_lines(spark, folder, *ALL, valid=False), target)
    raw = versions.newest_of_files(delimited.read_csv(spark, target, exports.FILES), ["Order ID", "SKU ID"], ["File_Modified", "File_Source", "File_Block", "File_Row"])
    return channels.clean_social_orders(raw, keywords=["ring"])


def _src_direct(spark, folder):
    target = _new_folder(spark, "export-direct")
    exports.direct_sales(table(spark, folder, "orders"), target)
    return channels.clean_direct_sales(delimited.read_csv(spark, target, exports.FILES))


def _src_ads(spark, folder):
    target = _new_folder(spark, "export-ads")
    exports.ads_reports(ads_raw(spark, folder), target)
    return promotion.clean_ads(delimited.read_ads_reports(spark, f"{target}/*", glob="*.txt"))


def _src_overview(spark, folder, kind):
    target = _new_folder(spark, f"export-{kind}")
    reports = _overview(spark, folder, kind)
    if kind == "live":
        columns = ["Sales_Confirmed", "Orders_Confirmed", "Total_Viewers", "Peak_Concurrent_Users", "GPM_Confirmed"]
        rules, clean = layouts.LIVE_OVERVIEW, promotion.clean_live_overview
    else:
        columns = ["Video_Sales_Confirmed", "Video_Orders_Confirmed", "Total_Viewers", "Video_GPM_Confirmed"]
        rules, clean = layouts.VIDEO_OVERVIEW, promotion.clean_video_overview
    exports.overview_reports(reports, rules, columns, target)
    return clean(delimited.read_overview_reports(spark, f"{target}/*", rules, glob="*.txt"))


def _table_files(spark, folder):
    return files.listing(spark, folder, "*.parquet").select("Name", "Signature", "Size", "path")


TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders",
    "pages", "part", "region", "supplier",
)


def _manifest(spark, folder):
    """All table files are new at first; none is after they are in the manifest."""
    found = _table_files(spark, folder)
    empty = spark.createDataFrame([], files.MANIFEST_SCHEMA)
    new = files.unprocessed(found, empty, "tables")
    counts = refresh.table_sizes({n: table(spark, folder, n) for n in TABLES})
    records = counts.select(F.concat("Table_Name", F.lit(".parquet")).alias("Name"), F.col("Rows").alias("Records"))
    manifest = files.latest_manifest(files.manifest_entries(new, records, "tables"))
    left = files.unprocessed(found, manifest, "tables").agg(F.count("*")).scalar()
    return manifest.withColumn("Still_Pending", left)


def _changed(spark, folder):
    """Against a snapshot without the events and with another state of the line items."""
    current = files.content_hashes(spark, folder, "*.parquet")
    before = current.filter(F.col("Name") != "events.parquet").withColumn(
        "Hash", F.when(F.col("Name") == "lineitem.parquet", F.reverse("Hash")).otherwise(F.col("Hash"))
    )
    return files.changed(current, before)


def _master_frames(spark, folder):
    lines = order_lines(spark, folder, *ALL)
    return {
        "daily_sales": masters.daily_sales(lines),
        "products": masters.product_master(lines),
        "geographic": masters.geographic(lines),
        "daily_geographic": masters.daily_geographic(lines),
        "ads_performance": masters.ads_master(ads(spark, folder)),
    }


def _catalog(spark, folder):
    frames = _master_frames(spark, folder)
    sinks.register_views(spark, frames, prefix="tradewind_")
    names = [r["Table_Name"] for r in tables.list_tables(spark, "tradewind_").collect()]
    result = None
    for name in sorted(names):
        part = tables.describe(spark, name)
        result = part if result is None else result.unionByName(part)
    return result


def _write_tables(spark, folder):
    target = _new_folder(spark, "tables")
    sinks.write_tables(_master_frames(spark, folder), target)
    names = ["daily_sales", "products", "geographic", "daily_geographic", "ads_performance"]
    return refresh.table_sizes(refresh.stored_tables(spark, target, names))


def _export_csv(spark, folder):
    target = _new_folder(spark, "csv")
    sinks.export_csv(_master_frames(spark, folder)["daily_sales"], target, "Master_Daily_Sales")
    back = delimited.read_csv(spark, f"{target}/Master_Daily_Sales")
    return back.withColumn("Date", F.col("Date").cast("date"))


def _full_refresh(spark, folder):
    target = _new_folder(spark, "full")
    lines = stage(order_lines(spark, folder, *ALL), "order-lines")  # joined once for all channels
    by_channel = {p: lines.filter(F.col("Platform") == p) for p in ("marketplace", "social", "direct")}
    social = {f"social_{k}": content(spark, folder, k).filter(F.col("Platform") == "social") for k in ("live", "video")}
    overview = {k: _overview(spark, folder, k) for k in ("live", "video")}
    names = refresh.full_refresh({**by_channel, **social, **overview, "ads": ads(spark, folder)}, target)
    return refresh.table_sizes(refresh.stored_tables(spark, target, names))


def _complete_run(spark, folder):
    """Source figures of the summary that a run with exports and views returns; one export is read back."""
    target = _new_folder(spark, "run")
    columns = refresh.LINE_COLUMNS + refresh.DIRECT_COLUMNS  # those that a run stores
    with staged(channels.key_columns(order_lines(spark, folder, *ALL), columns), "order-lines") as lines:  # joined once for all channels
        by_channel = {p: lines.filter(F.col("Platform") == p) for p in ("marketplace", "social")}
        social = {f"social_{k}": content(spark, folder, k).filter(F.col("Platform") == "social") for k in ("live", "video")}
        summary = refresh.complete_run({**by_channel, **social}, f"{target}/tables", f"{target}/csv", "run_", "gzip")
    exported = delimited.read_csv(spark, f"{target}/csv/daily_sales", exports.FILES).agg(
        F.lit("exported_GMV").alias("Metric"), F.sum(F.col("GMV").cast("double")).alias("Value")
    )
    return summary.unionByName(exported)


def _exported_lines(spark, folder):
    """What social exports hold of the order lines, joined once for several exports and kept until they are written. A file of an
    export has all lines of its orders."""
    return staged(order_lines(spark, folder, *ALL, valid=False).select(*exports.SOCIAL_COLUMNS), "order-lines", together="Order_ID")


def _incremental(spark, folder):
    """Two exports: the second corrects the orders from 1999 on, which the first has with other values."""
    root = _new_folder(spark, "incremental")
    corrected = F.col("Order_Date") >= F.lit("1999-01-01").cast("timestamp")
    store = refresh.OrderStore(spark, f"{root}/store")
    with _exported_lines(spark, folder) as lines:
        old = lines.filter(F.col("Order_Date") < F.lit("2000-01-01").cast("timestamp"))
        old = old.withColumns(
            {
                "Net_Sales": F.when(corrected, F.col("Net_Sales") + 1).otherwise(F.col("Net_Sales")),
                "Order_Status": F.when(corrected, F.lit("F")).otherwise(F.col("Order_Status")),
            }
        )
        exports.social_orders(old, f"{root}/exports")
        store.ingest(f"{root}/exports", exports.FILES)
        exports.social_orders(lines.filter(corrected), f"{root}/exports")
    names = store.refresh(f"{root}/exports", f"{root}/tables", glob=exports.FILES)
    return refresh.stored_tables(spark, f"{root}/tables", names)["daily_sales"]


def _monthly(spark, folder, table_name):
    """A master table of a store by month, which every query builds of the tables as they are now."""
    return _monthly_store(spark, folder).tables()[table_name]


def _monthly_store(spark, folder):
    """As above, kept by month: the second run corrects orders from 1999 on, and moves those of the first days of a month
    to the month before."""
    root = _new_folder(spark, "monthly")
    corrected = F.col("Order_Date") >= F.lit("1999-01-01").cast("timestamp")
    moved = corrected & (F.dayofmonth("Order_Date") <= 3)
    raw = refresh.OrderStore(spark, f"{root}/store")
    store = months.social_store(spark, f"{root}/months")
    with _exported_lines(spark, folder) as lines:
        old = lines.filter(F.col("Order_Date") < F.lit("2000-01-01").cast("timestamp"))
        old = old.withColumns(
            {
                "Net_Sales": F.when(corrected, F.col("Net_Sales") + 1).otherwise(F.col("Net_Sales")),
                "Order_Status": F.when(corrected, F.lit("F")).otherwise(F.col("Order_Status")),
                "Order_Date": F.when(moved, F.date_sub("Order_Date", 5).cast("timestamp")).otherwise(F.col("Order_Date")),
            }
        )
        exports.social_orders(old, f"{root}/exports")
        months.refresh_months(raw, store, f"{root}/exports", exports.FILES)
        exports.social_orders(lines.filter(corrected), f"{root}/exports")
    months.refresh_months(raw, store, f"{root}/exports", exports.FILES)
    return store


def _stream_months(spark, folder):
    """Three sets of order files as a stream, each a micro-batch; the second corrects half of the orders of the first. All rows of an
    order are in one file of a set. The stream is started once more from its checkpoint."""
    root = _new_folder(spark, "stream-months")
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    old = orders.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderdate": F.date_add("o_orderdate", 20).cast("timestamp")})
    store = months.MonthlyStore(spark, f"{root}/months", lambda df: df, order_key="o_orderkey", date=F.col("o_orderdate"), parts=lambda lines: {})
    for part in (old.filter("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"), orders.filter("o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"), orders.filter("o_orderkey % 6 = 3")):
        part.repartition("o_orderkey").write.mode("append").parquet(f"{root}/files")
        stream = ingest.file_stream(spark, f"{root}/files", orders.schema, "parquet", "*.parquet")
        ingest.merge(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.rows()


def _stream(spark, folder):
    """The orders file as a stream of one micro-batch, then the newest row per order."""
    target = _new_folder(spark, "stream")
    stream = ingest.file_stream(spark, folder, table(spark, folder, "orders").schema, "parquet", "orders.parquet")
    ingest.ingest(stream, f"{target}/batches", f"{target}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{target}/batches", ["o_orderkey"])


def _stored_all_orders(spark, folder):
    """The view over stored tables: written by month, read back with a date filter."""
    target = _new_folder(spark, "orders")
    sinks.write_tables({"orders_raw": _all_orders(spark, folder)}, target)
    return sinks.read_table(spark, target, "orders_raw", start=date(2000, 1, 1))


_KEYWORDS = "NOT contains(lower(\"Product_Name\"), 'ring')"
_SOCIAL_DAILY = """SELECT "Order_Date_Only" AS "Date", 'social' AS "Platform", count(DISTINCT "Order_ID") AS "Orders", sum("Net_Sales") AS "GMV",
  sum("Net_Sales") AS "Net_Revenue", sum("Quantity") AS "Units_Sold", 0 AS "Total_Fees", sum("Total_Discount") AS "Total_Discount",
  0 AS "Commission", 0 AS "Transaction_Fee", 0 AS "Service_Fee", CAST(sum("Net_Sales") AS DOUBLE) / count(DISTINCT "Order_ID") AS "AOV"
  FROM lines GROUP BY 1"""
_COUNTS = {
    "daily_sales": "daily_totals",
    "products": "product_totals",
    "geographic": "geographic",
    "daily_geographic": "daily_geographic",
    "ads_performance": "ads_master",
}


def _counts(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"Table_Name\", count(*) AS \"Rows\" FROM {t}" for n, t in pairs.items())


_ALL_TABLES = {
    **_COUNTS,
    "customer_rfm": "rfm",
    "segment_summary": '(SELECT DISTINCT "Segment" FROM rfm)',
    "orders_raw": "(SELECT * FROM lines WHERE \"Platform\" = 'marketplace')",
    "social_orders": "(SELECT * FROM lines WHERE \"Platform\" = 'social')",
    "direct_orders": "(SELECT * FROM lines WHERE \"Platform\" = 'direct')",
    "combined_live": f"({_overview_sql('live', 'Live', 'NULL')})",
    "combined_video": f"({_overview_sql('video', 'Video', 'NULL')})",
    "social_live": "(SELECT * FROM live WHERE \"Platform\" = 'social')",
    "social_video": "(SELECT * FROM video WHERE \"Platform\" = 'social')",
}
_ORDER = "Order_ID:s Order_Status:s Order_Date:t Order_Date_Only:d Product_Name:s SKU:s Quantity:f4 Net_Sales:f4 Total_Fees:f4 True_Net_Revenue:f4 Total_Discount:f4 Platform:s Province:s Buyer_Username:s"


def _order_sql(platform: str, names: dict[str, str], fees: bool) -> str:
    status = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    total, net = ('"Total_Fees"', '"True_Net_Revenue"') if fees else ("0", '"Net_Sales"')
    return f"""SELECT * EXCLUDE ("Order_Status", "Platform", "Total_Fees", "True_Net_Revenue"), '{platform}' AS "Platform",
      CASE "Order_Status" {status} END AS "Order_Status", {total} AS "Total_Fees", {net} AS "True_Net_Revenue" FROM lines WHERE {_KEYWORDS}"""


CHECKS = [
    Check(
        "src_orders",
        _ORDER,
        _src_orders,
        _order_sql("marketplace", {"F": "สำเร็จแล้ว", "O": "กำลังจัดส่ง"}, True),
        _LINES,
    ),
    Check(
        "src_social_orders",
        _ORDER,
        _src_social_orders,
        _order_sql("social", {"F": "เสร็จสมบูรณ์", "O": "จัดส่งแล้ว"}, False),
        _LINES,
    ),
    Check(
        "src_direct",
        "Order_ID:s Order_Date:t Customer_Type:s Net_Sales:f4 Total_Amount:f4 Quantity:f4 Platform:s",
        _src_direct,
        """SELECT o_orderkey AS "Order_ID", o_orderdate AS "Order_Date", o_orderpriority AS "Customer_Type", round(o_totalprice, 2) AS "Net_Sales",
             round(o_totalprice, 2) AS "Total_Amount", 1 AS "Quantity", 'direct' AS "Platform" FROM orders""",
    ),
    Check(
        "src_ads",
        "Ad_Name:s Ad_Type:s Status:s Impressions:l Clicks:l Orders:l Direct_Orders:l Sales:f4 Ad_Cost:f4 CTR:f6 Conversion_Rate:f6 ROAS:f6 ACOS:f6",
        _src_ads,
        "SELECT * FROM ads_clean",
        (ADS_RAW, ADS),
    ),
    Check(
        "src_live",
        "Report_Date:d Sales_Confirmed:f2 Orders_Confirmed:l Total_Viewers:l Peak_Concurrent_Users:l GPM_Confirmed:f2 Platform:s",
        lambda s, f: _src_overview(s, f, "live"),
        f"""SELECT "Report_Date", "Sales" AS "Sales_Confirmed", "Orders" AS "Orders_Confirmed", "Viewers" AS "Total_Viewers",
              "PCU" AS "Peak_Concurrent_Users", coalesce("GPM", 0) AS "GPM_Confirmed", 'marketplace' AS "Platform"
            FROM ({_overview_sql("live", "Live", 'max("Viewers")')})""",
        (CONTENT,),
    ),
    Check(
        "src_video",
        "Report_Date:d Video_Sales_Confirmed:f2 Video_Orders_Confirmed:l Total_Viewers:l Video_GPM_Confirmed:f2 Platform:s",
        lambda s, f: _src_overview(s, f, "video"),
        f"""SELECT "Report_Date", "Sales" AS "Video_Sales_Confirmed", "Orders" AS "Video_Orders_Confirmed", "Viewers" AS "Total_Viewers",
              coalesce("GPM", 0) AS "Video_GPM_Confirmed", 'marketplace' AS "Platform" FROM ({_overview_sql("video", "Video", "NULL")})""",
        (CONTENT,),
    ),
    Check(
        "manifest_new_files",
        "Data_Type:s Name:s Records:l Still_Pending:l",
        _manifest,
        " UNION ALL ".join(f"SELECT 'tables' AS \"Data_Type\", '{n}.parquet' AS \"Name\", count(*) AS \"Records\", 0 AS \"Still_Pending\" FROM {n}" for n in TABLES),
    ),
    Check(
        "changed_files",
        "Folder:s Name:s Status:s",
        _changed,
        """SELECT '' AS "Folder", 'events.parquet' AS "Name", 'new' AS "Status" UNION ALL SELECT '', 'lineitem.parquet', 'modified'""",
    ),
    Check("catalog_tables", "Table_Name:s Column_Name:s Data_Type:s", _catalog),
    Check(
        "write_tables",
        "Table_Name:s Rows:l",
        _write_tables,
        _counts(_COUNTS),
        (*_LINES, DAILY, PRODUCTS, GEO, DAILY_GEO, ADS_RAW, ADS),
    ),
    Check(
        "run_sources",
        "Metric:s Value:f2",
        _complete_run,
        """SELECT p || '_' || m AS "Metric", v AS "Value" FROM (
             SELECT "Platform" AS p, unnest(['Records', 'Orders', 'GMV', 'Quantity']) AS m,
               unnest([CAST(count(*) AS DOUBLE), count(DISTINCT "Order_ID"), CAST(sum("Net_Sales") AS DOUBLE), sum("Quantity")]) AS v
             FROM lines WHERE "Platform" <> 'direct' GROUP BY 1
             UNION ALL SELECT 'social_live', unnest(['Records', 'GMV', 'Orders', 'Viewers']),
               unnest([CAST(count(*) AS DOUBLE), coalesce(CAST(sum("GMV") AS DOUBLE), 0), coalesce(sum("Orders"), 0), coalesce(sum("Viewers"), 0)])
             FROM live WHERE "Platform" = 'social'
             UNION ALL SELECT 'social_video', unnest(['Records', 'GMV', 'Orders', 'Views']),
               unnest([CAST(count(*) AS DOUBLE), coalesce(CAST(sum("GMV") AS DOUBLE), 0), coalesce(sum("Orders"), 0), coalesce(sum("Views"), 0)])
             FROM video WHERE "Platform" = 'social')
           UNION ALL SELECT 'exported_GMV', CAST(sum("Net_Sales") AS DOUBLE) FROM lines WHERE "Platform" <> 'direct'""",
        (*_LINES, CONTENT),
    ),
    Check("export_csv", f"Date:d Platform:s {_MASTER_SUMS}", _export_csv, "SELECT * FROM daily_totals", (*_LINES, DAILY)),
    Check(
        "stored_orders",
        "Order_ID:s Order_Date:t Platform:s Net_Sales:f4",
        _stored_all_orders,
        "SELECT * FROM lines WHERE \"Order_Date\" >= TIMESTAMP '2000-01-01'",
        _LINES,
    ),
    Check(
        "full_refresh",
        "Table_Name:s Rows:l",
        _full_refresh,
        _counts(_ALL_TABLES),
        (*_LINES, DAILY, PRODUCTS, GEO, DAILY_GEO, ADS_RAW, ADS, CONTENT, _RFM),
    ),
    Check(
        "incremental_refresh",
        f"Date:d Platform:s {_MASTER_SUMS}",
        _incremental,
        _SOCIAL_DAILY,
        _LINES,
    ),
    Check(
        "incremental_months",
        f"Date:d Platform:s {_MASTER_SUMS}",
        lambda s, f: _monthly(s, f, "daily_sales"),
        _SOCIAL_DAILY,
        _LINES,
    ),
    Check(
        "incremental_months_products",
        "Product_Name:s SKU:s Orders:l Total_GMV:f2 Total_Qty:f2",
        lambda s, f: _monthly(s, f, "products"),
        """SELECT "Product_Name", "SKU", count(DISTINCT "Order_ID") AS "Orders", sum("Net_Sales") AS "Total_GMV", sum("Quantity") AS "Total_Qty"
           FROM lines GROUP BY 1, 2""",
        _LINES,
    ),
    Check(
        "incremental_months_customers",
        "Customer_ID:s Recency:l Frequency:l Monetary:f2 R_Score:i F_Score:i M_Score:i Segment:s",
        lambda s, f: _monthly(s, f, "customer_rfm"),
        "SELECT * FROM rfm",
        (*_LINES, _RFM),
    ),
    Check("stream_months", "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:f2 o_orderdate:t", _stream_months, "SELECT * FROM orders"),
    Check(
        "stream_ingest",
        "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:f2 o_orderdate:t",
        _stream,
        "SELECT * FROM orders",
    ),
]
