"""Stored tables: catalogue access with an empty fallback, and ordered loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Order in which a stored table is shown; the second value tells a descending order.
SHOWN_BY = {
    "daily_sales": ("Date", False),
    "products": ("Total_GMV", True),
    "ads_performance": ("ROAS", True),
    "geographic": ("GMV", True),
    "daily_geographic": ("Date", False),
    "orders_raw": ("Order_Date", True),
    "social_orders": ("Order_Date", True),
    "direct_orders": ("Order_Date", True),
    "all_orders": ("Order_Date", True),
    "combined_live": ("Report_Date", True),
    "combined_video": ("Report_Date", True),
    "social_live": ("Report_Date", True),
    "social_video": ("Post_Date", True),
}
ORDER_TABLES = ("orders_raw", "social_orders", "direct_orders")


def load_or_empty(spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
    """The table or view, or no rows with ``schema`` when it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, name: str, ordered: bool = False, prefix: str = "", schema: StructType | str = "") -> DataFrame:
    """A table or view, in the order it is shown if asked for; without rows (and with ``schema``) when there is none.

    ``all_orders`` without a view is the union of the order tables that exist."""
    if name == "all_orders" and not spark.catalog.tableExists(prefix + name):
        parts = [spark.table(prefix + t) for t in ORDER_TABLES if spark.catalog.tableExists(prefix + t)]
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], schema or StructType([]))
    else:
        table = load_or_empty(spark, prefix + name, schema or StructType([]))
    column, descending = SHOWN_BY.get(name, (None, False))
    if not ordered or column not in table.columns:
        return table
    return table.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last())


def list_tables(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Names and kinds of the tables and views of the session."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    return spark.createDataFrame(rows, "Table_Name string, Table_Type string, Is_Temporary boolean")


def describe(spark: SparkSession, name: str) -> DataFrame:
    rows = [(name, f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
    return spark.createDataFrame(rows, "Table_Name string, Column_Name string, Data_Type string")
