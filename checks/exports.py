"""Raw exports written from the benchmark tables in the layouts the readers expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.sources import layouts

# What ``social_orders`` reads of the order lines.
SOCIAL_COLUMNS = [
    "Order_ID", "Order_Status", "Line_Key", "SKU", "Product_Name", "Quantity", "Net_Sales", "Platform_Discount", "Seller_Discount",
    "Order_Date", "Province", "Buyer_Username",
]


def _source_name(layout: dict[str, str], canonical: str) -> str:
    return next(source for source, name in layout.items() if name == canonical)


def _with_headers(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(_source_name(layout, c)) for c in df.columns])


# Exports as they are written here, compressed, and plain ones.
FILES = "*.{csv,csv.gz}"


def _write_csv(df: DataFrame, folder: str, mode: str = "append") -> None:
    options = {"header": True, "quote": '"', "escape": '"', "ignoreTrailingWhiteSpace": False, "ignoreLeadingWhiteSpace": False}
    df.write.mode(mode).options(**options, compression="gzip").csv(folder)


def _status(names: dict[str, str]):
    status = F.col("Order_Status")
    return F.when(status == "F", names["F"]).when(status == "O", names["O"]).otherwise(names["P"])


def marketplace_orders(lines: DataFrame, folder: str) -> None:
    """Order lines with baht text in the money columns."""

    def baht(column):
        return F.concat(F.lit("฿"), F.format_number(F.col(column).cast("decimal(18,4)"), 4))

    df = lines.select(
        F.col("Order_ID").cast("string"),
        _status({"F": "สำเร็จแล้ว", "O": "กำลังจัดส่ง", "P": "ยกเลิกแล้ว"}).alias("Order_Status"),
        F.date_format("Order_Date", "yyyy-MM-dd HH:mm").alias("Order_Date"),
        "Product_Name",
        "SKU",
        *[baht(c).alias(c) for c in ("Original_Price", "Net_Sales", "Platform_Discount", "Seller_Discount", "Commission", "Transaction_Fee", "Service_Fee")],
        F.col("Quantity").cast("string"),
        "Province",
        "Buyer_Username",
    )
    _write_csv(_with_headers(df, layouts.MARKETPLACE_ORDERS), folder)


def social_orders(lines: DataFrame, folder: str) -> None:
    """Order lines with a tab after the time, as the platform writes it."""
    df = lines.select(
        F.col("Order_ID").cast("string"),
        _status({"F": "เสร็จสมบูรณ์", "O": "จัดส่งแล้ว", "P": "ยกเลิกแล้ว"}).alias("Order_Status"),
        F.col("Line_Key").alias("SKU_ID"),
        "SKU",
        "Product_Name",
        *[F.col(c).cast("string").alias(c) for c in ("Quantity", "Net_Sales", "Platform_Discount", "Seller_Discount")],
        F.concat(F.date_format("Order_Date", "dd/MM/yyyy HH:mm:ss"), F.lit("\t")).alias("Order_Date"),
        "Province",
        "Buyer_Username",
    )
    _write_csv(_with_headers(df, layouts.SOCIAL_ORDERS), folder)


def direct_sales(orders: DataFrame, folder: str) -> None:
    """Documents with a total row without a number, and dates written day first."""
    df = orders.select(
        F.col("o_orderkey").cast("string").alias("Order_ID"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Order_Date"),
        F.col("o_orderpriority").alias("Customer_Type"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Net_Sales"),
        F.lit("0").alias("VAT"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Total_Amount"),
    )
    total = orders.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("Net_Sales"))
    _write_csv(_with_headers(df.unionByName(total, allowMissingColumns=True), layouts.DIRECT_SALES), folder)


def ads_reports(ads: DataFrame, folder: str) -> None:
    """One report per ad type: free text, the header line, then the ads."""
    columns = ["Ad_Name", "Status", "Ad_Type", "Impressions", "Clicks", "CTR", "Orders", "Direct_Orders", "Conversion_Rate",
               "Products_Sold", "Sales", "Direct_Sales", "Ad_Cost", "ROAS", "ACOS"]
    header = ",".join([layouts.ADS_HEADER_START, *[f'"{_source_name(layouts.ADS, c)}"' for c in columns]])
    quoted = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in columns]
    rows = ads.select("Ad_Type", F.lit(2).alias("at"), F.concat_ws(",", F.lit("1"), *quoted).alias("value"))
    top = ads.select("Ad_Type").distinct().select(
        "Ad_Type", F.posexplode(F.array(F.lit("รายงานโฆษณา, ทั้งหมด"), F.lit(header))).alias("at", "value")
    )
    lines = top.unionByName(rows).repartition("Ad_Type").sortWithinPartitions("Ad_Type", "at")
    lines.select(F.col("Ad_Type").alias("report"), "value").write.mode("append").partitionBy("report").text(folder)


def overview_reports(reports: DataFrame, rules: list[tuple[str, str]], columns: list[str], folder: str) -> None:
    """One report per day: the two header rows, in which a blank repeats the header to its left, and a data row."""
    texts = {name: text for text, name in rules}
    upper, lower = [], []
    for column in columns:
        head, _, rest = texts[column].partition("(")
        upper.append(texts[column] if not rest else f"{head}({rest}")
        lower.append("")
    # A last column without an upper header: its combined name repeats the one before it and is ignored.
    header = [",".join([*upper, ""]), ",".join([*lower, "เทียบกับก่อนหน้า"])]
    figures = [F.concat(F.lit('"'), F.coalesce(F.format_number(F.col(c), 4), F.lit("")), F.lit('"')) for c in columns]
    row = F.concat_ws(",", *figures, F.lit("0"))
    value = F.concat_ws("\n", *[F.lit(h) for h in header], row)
    reports.select(F.col("Report_Date").cast("string").alias("report"), value.alias("value")).repartition("report").write.mode(
        "append"
    ).partitionBy("report").text(folder)
