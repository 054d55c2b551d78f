"""Cleaning of the order channels and their union into one order model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import parsing
from tradewind.sources import layouts

ORDER_KEY_COLUMNS = [
    "Order_ID", "Order_Status", "Order_Date", "Product_Name", "SKU",
    "Quantity", "Net_Sales", "True_Net_Revenue", "Platform", "Province",
]


def with_missing(df: DataFrame, columns: Iterable[str], value) -> DataFrame:
    """Add absent columns with a constant."""
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: value for c in absent}) if absent else df


def converted(df: DataFrame, columns: Iterable[str], parse) -> DataFrame:
    """Parse the listed columns; absent ones become 0."""
    df = with_missing(df, columns, F.lit(None).cast("string"))
    return df.withColumns({c: parse(c) for c in columns})


def keep_statuses(df: DataFrame, valid: Sequence[str]) -> DataFrame:
    """Rows with a valid order status; a null status is dropped."""
    return df.filter(F.col("Order_Status").isin(list(valid)))


def drop_keywords(df: DataFrame, keywords: Sequence[str], column: str = "Product_Name") -> DataFrame:
    """Drop rows whose lower-cased name contains a keyword; null names stay."""
    if column not in df.columns:
        return df
    found = F.lower(column).rlike("|".join(keywords))
    return df.filter(~F.coalesce(found, F.lit(False)))


def with_totals(df: DataFrame) -> DataFrame:
    """Fees, net revenue and discount of an order line; missing parts count as 0."""

    def part(name: str) -> Column:
        zero = F.lit(0).cast(parsing.MONEY)
        return F.coalesce(F.col(name), zero) if name in df.columns else zero

    df = df.withColumns(
        {
            "Total_Fees": part("Commission") + part("Transaction_Fee") + part("Service_Fee"),
            "Total_Discount": part("Platform_Discount") + part("Seller_Discount"),
        }
    )
    return df.withColumn("True_Net_Revenue", part("Net_Sales") - F.col("Total_Fees"))


def with_order_date(df: DataFrame, parse) -> DataFrame:
    return df.withColumn("Order_Date", parse("Order_Date")).withColumn(
        "Order_Date_Only", F.to_date("Order_Date")
    )


def clean_marketplace_orders(
    raw: DataFrame,
    statuses: Sequence[str] = layouts.MARKETPLACE_STATUSES,
    keywords: Sequence[str] = layouts.EXCLUDED_KEYWORDS,
) -> DataFrame:
    df = raw.withColumnsRenamed(layouts.MARKETPLACE_ORDERS)
    df = drop_keywords(keep_statuses(df, statuses), keywords)
    df = converted(with_order_date(df, parsing.timestamp_iso), layouts.MARKETPLACE_ORDER_NUMBERS, parsing.currency)
    return with_totals(df).withColumn("Platform", F.lit("marketplace"))


def clean_social_orders(
    raw: DataFrame,
    statuses: Sequence[str] = layouts.SOCIAL_STATUSES,
    keywords: Sequence[str] = layouts.EXCLUDED_KEYWORDS,
) -> DataFrame:
    """Social-commerce orders; this export has no fees, so net revenue equals net sales."""
    df = raw.withColumnsRenamed(layouts.SOCIAL_ORDERS)
    df = drop_keywords(keep_statuses(df, statuses), keywords)
    df = converted(
        with_order_date(df, parsing.timestamp_dmy),
        layouts.SOCIAL_ORDER_NUMBERS,
        parsing.numeric,
    )
    zero = F.lit(0).cast(parsing.MONEY)
    df = df.withColumns({c: zero for c in ("Commission", "Transaction_Fee", "Service_Fee")})
    return with_totals(df).withColumn("Platform", F.lit("social"))


def clean_direct_sales(raw: DataFrame) -> DataFrame:
    """Direct sales: one unit per document, no product, fees or province; total rows are dropped."""
    df = raw.withColumnsRenamed(layouts.DIRECT_SALES)
    has_type = "Customer_Type" in df.columns
    df = df.dropna(subset=["Order_ID", "Customer_Type"] if has_type else ["Order_ID"])
    df = with_order_date(df, parsing.timestamp_day_first).filter(F.col("Order_Date").isNotNull())
    df = converted(df, layouts.DIRECT_SALES_NUMBERS, parsing.numeric)
    zero, channel = F.lit(0).cast(parsing.MONEY), F.col("Customer_Type") if has_type else F.lit("Direct")
    return df.withColumns(
        {
            "Quantity": F.lit(1).cast(parsing.MONEY),
            **{c: zero for c in ("Return_Qty", "Total_Discount", "Total_Fees", "Commission", "Transaction_Fee", "Service_Fee")},
            "True_Net_Revenue": F.col("Net_Sales"),
            "Product_Name": F.lit("Direct Sale"),
            "SKU": F.lit("N/A"),
            "Province": F.lit("Unknown"),
            "Sales_Channel": F.coalesce(channel, F.lit("Direct")),
            "Platform": F.lit("direct"),
        }
    )


def unify(*channels: DataFrame) -> DataFrame:
    """All channels in one frame; columns a channel lacks are null."""
    result = channels[0]
    for channel in channels[1:]:
        result = result.unionByName(channel, allowMissingColumns=True)
    return result


def all_orders(marketplace: DataFrame, social: DataFrame, direct: DataFrame) -> DataFrame:
    """The ten key columns of every channel, with the constants direct sales lack."""
    constants = {
        "Order_Status": F.lit(None).cast("string"),
        "Product_Name": F.lit("Direct Sale"),
        "SKU": F.lit("N/A"),
        "Province": F.lit("Unknown"),
        "True_Net_Revenue": F.col("Net_Sales"),
    }
    direct = direct.withColumns(constants)
    return unify(*[c.select(*ORDER_KEY_COLUMNS) for c in (marketplace, social, direct)])


def key_columns(df: DataFrame, columns: Sequence[str] = ORDER_KEY_COLUMNS) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
