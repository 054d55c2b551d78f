"""Building all tables, from scratch or after new export files arrived."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import channels, customers, masters, versions
from tradewind.functions.numbers import total
from tradewind.plans.sinks import export_csv, read_table, register_views, write_table, write_tables
from tradewind.session import COMPACT, stage
from tradewind.sources import delimited, files, layouts

REJECTED_SCHEMA = "Name string, Signature string, Reason string, Rejected_At timestamp"
# What the master tables read from the unified order lines.
LINE_COLUMNS = [
    "Order_ID", "Order_Status", "Order_Date", "Order_Date_Only", "Product_Name", "SKU", "Quantity",
    "Net_Sales", "True_Net_Revenue", "Total_Fees", "Total_Discount", "Commission", "Transaction_Fee",
    "Service_Fee", "Platform", "Province", "Buyer_Username",
]
# What direct sales have in addition.
DIRECT_COLUMNS = ["Customer_Type", "Sales_Channel", "VAT", "Total_Amount"]
REPORT_TABLES = {"live": "combined_live", "video": "combined_video", "social_live": "social_live", "social_video": "social_video"}
CHANNEL_TABLES = {"marketplace": "orders_raw", "social": "social_orders", "direct": "direct_orders"}


def master_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables that only need the unified order lines; the lines should be stored tables."""
    tables = {"daily_sales": masters.daily_sales(lines), "products": masters.product_master(lines)}
    if "Province" in lines.columns:
        tables["geographic"] = masters.geographic(lines)
        tables["daily_geographic"] = masters.daily_geographic(lines)
    if any(c in lines.columns for c in customers.CUSTOMER_COLUMNS):
        rfm = stage(customers.customer_rfm(lines), "customer-rfm")
        tables["customer_rfm"] = rfm
        tables["segment_summary"] = customers.segment_summary(rfm)
    return tables


def full_refresh(sources: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Build and store every table the given cleaned sources allow; returns the table names.

    Sources: ``marketplace``, ``social``, ``direct`` (order lines), ``ads``, ``live``, ``video``,
    ``social_live``, ``social_video``. The cleaned lines of each channel are stored first and in full; the
    master tables are built from the stored columns, so no export is parsed twice.
    """
    stored: dict[str, DataFrame] = {}
    for channel, name in CHANNEL_TABLES.items():
        if channel in sources:
            source = sources[channel]
            write_table(channels.key_columns(source, LINE_COLUMNS + DIRECT_COLUMNS), folder, name)
            stored[name] = read_table(source.sparkSession, folder, name)
    tables: dict[str, DataFrame] = {}
    if stored:
        parts = [channels.key_columns(df, LINE_COLUMNS) for df in stored.values()]
        tables.update(master_tables(channels.unify(*parts)))
    if "ads" in sources:
        tables["ads_performance"] = masters.ads_master(sources["ads"])
    tables.update({name: sources[source] for source, name in REPORT_TABLES.items() if source in sources})
    write_tables(tables, folder)
    return [*stored, *tables]


def stored_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table as a frame (table name, rows)."""
    counts = [df.agg(F.count("*").alias("Rows")).select(F.lit(name).alias("Table_Name"), "Rows") for name, df in tables.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def _long(row: DataFrame) -> DataFrame:
    """The columns of a one-row frame as (Metric, Value)."""
    pairs = [F.struct(F.lit(c).alias("Metric"), F.col(c).cast("double").alias("Value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def run_summary(daily: DataFrame, products: DataFrame, ads: DataFrame) -> DataFrame:
    """Headline figures of a run as (metric, value)."""

    sales = daily.agg(
        F.unix_date(F.min("Date")).alias("First_Day"),
        F.unix_date(F.max("Date")).alias("Last_Day"),
        F.sum("Orders").alias("Total_Orders"),
        F.sum("GMV").alias("Total_GMV"),
        F.sum("Net_Revenue").alias("Total_Net_Revenue"),
        F.avg("AOV").alias("Average_AOV"),
    )
    catalogue = products.agg(
        F.count("*").alias("Products"),
        F.count_if(F.contains("Product_Segment", F.lit("Star"))).alias("Star_Products"),
        F.count_if(F.contains("Product_Segment", F.lit("Hero"))).alias("Hero_Products"),
    )
    promotion = ads.agg(
        F.count("*").alias("Campaigns"),
        F.sum("Ad_Cost").alias("Ad_Spend"),
        F.sum("Sales").alias("Ad_Sales"),
        F.avg("ROAS").alias("Average_ROAS"),
    )
    return _long(sales).unionByName(_long(catalogue)).unionByName(_long(promotion))


# Per source: what a run reports as (metric, column), summed; the records and, of orders, the distinct orders as well.
SOURCE_SUMS = {
    "marketplace": (("GMV", "Net_Sales"), ("Quantity", "Quantity")),
    "social": (("GMV", "Net_Sales"), ("Quantity", "Quantity")),
    "direct": (("GMV", "Net_Sales"), ("Total_With_VAT", "Total_Amount")),
    "social_live": (("GMV", "GMV"), ("Orders", "Orders"), ("Viewers", "Viewers")),
    "social_video": (("GMV", "GMV"), ("Orders", "Orders"), ("Views", "Views")),
    "live": (("GMV", "Sales_Confirmed"), ("Orders", "Orders_Confirmed"), ("Viewers", "Total_Viewers")),
    "video": (("GMV", "Video_Sales_Confirmed"), ("Orders", "Video_Orders_Confirmed"), ("Viewers", "Total_Viewers")),
}


def source_summary(sources: Mapping[str, DataFrame]) -> DataFrame | None:
    """Figures of each source of a run as (Metric, Value); None without known sources."""
    parts = []
    for name, figures in SOURCE_SUMS.items():
        if name not in sources:
            continue
        df = sources[name]
        found = {f"{name}_Records": F.count("*")}
        if name in CHANNEL_TABLES:
            found[f"{name}_Orders"] = F.count_distinct("Order_ID")
        found |= {f"{name}_{metric}": total(column) for metric, column in figures if column in df.columns}
        parts.append(_long(df.agg(*[column.cast("double").alias(metric) for metric, column in found.items()])))
    return reduce(DataFrame.unionByName, parts) if parts else None


def complete_run(
    sources: Mapping[str, DataFrame], folder: str, exports: str | None = None, views: str | None = None, compression: str = "none"
) -> DataFrame:
    """A full refresh with all that belongs to a run: tables, CSV exports below ``exports`` (compressed, if asked for), views with
    the prefix ``views``. Returns the summary of the run, as (Metric, Value), from the stored tables."""
    spark = next(iter(sources.values())).sparkSession
    tables = stored_tables(spark, folder, full_refresh(sources, folder))
    if exports:
        for name, df in tables.items():
            export_csv(df, exports, name, compression)
    if views is not None:
        register_views(spark, tables, views)
    stored = {source: tables[name] for source, name in {**CHANNEL_TABLES, **REPORT_TABLES}.items() if name in tables}
    parts = [source_summary(stored)]
    if {"daily_sales", "products", "ads_performance"} <= set(tables):
        parts.append(run_summary(tables["daily_sales"], tables["products"], tables["ads_performance"]))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


@dataclass
class OrderStore:
    """Raw order lines kept as append-only batches, with a manifest of the files they came from.

    A run writes its batch first and the manifest rows last. A batch without manifest rows is not read, so
    a run that failed half-way is simply repeated. A changed file is read again. Files that cannot be read are listed
    with the reason in ``rejected`` and stay pending; they do not stop the others.
    """

    spark: SparkSession
    folder: str
    data_type: str = "social_orders"
    order_key: str = "Order ID"

    @property
    def _manifest_path(self) -> str:
        return f"{self.folder}/file_manifest"

    @property
    def _rejected_path(self) -> str:
        return f"{self.folder}/rejected_files"

    def _exists(self, path: str) -> bool:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)

    def _table(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._table(self._manifest_path, files.MANIFEST_SCHEMA + ", Batch int")

    def rejected(self) -> DataFrame:
        """Files that a run could not read: ``Name``, ``Signature``, ``Reason`` and when."""
        return self._table(self._rejected_path, REJECTED_SCHEMA)

    def pending(self, exports: str, glob: str = "*.csv") -> DataFrame:
        """Files whose newest entry is of another state, or that have none."""
        newest_entries = files.latest_manifest(self.manifest())
        return files.unprocessed(files.listing(self.spark, exports, glob), newest_entries, self.data_type)

    def ingest(self, exports: str, glob: str = "*.csv", force: bool = False) -> int:
        """Read new and changed export files into a batch; returns their number. ``force`` reads all files.

        The state of the files is taken once, before they are read: a file that changes meanwhile has another state
        than its entry and is read again by the next run."""
        found = files.listing(self.spark, exports, glob) if force else self.pending(exports, glob)
        waiting = found.select("path", "Name", "Signature").collect()
        if not waiting:
            return 0
        names_of = delimited.headers(self.spark, [row["path"] for row in waiting])
        rejected = [(r["Name"], r["Signature"], "no header") for r in waiting if r["path"] not in names_of]
        if rejected:
            rows = self.spark.createDataFrame(rejected, "Name string, Signature string, Reason string")
            rows.withColumn("Rejected_At", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._rejected_path)
        readable = [row for row in waiting if row["path"] in names_of]
        if not readable:
            return 0
        last = self.manifest().agg(F.max("Batch")).first()[0]
        number = 0 if last is None else last + 1
        rows = delimited.read_files(self.spark, [row["path"] for row in readable], names_of)
        rows.write.mode("overwrite").options(**COMPACT).parquet(f"{self.folder}/batches/{number}")
        self.commit(number, self.spark.createDataFrame([(r["Name"], r["Signature"]) for r in readable], "Name string, Signature string"))
        return len(readable)

    def commit(self, number: int, processed: DataFrame) -> None:
        batch = self.spark.read.parquet(f"{self.folder}/batches/{number}")
        records = batch.groupBy(F.col("File_Source").alias("Name")).agg(F.count("*").alias("Records"))
        entries = files.manifest_entries(processed, records, self.data_type).withColumn("Batch", F.lit(number))
        entries.coalesce(1).write.mode("append").parquet(self._manifest_path)

    def current(self, clean: Callable[[DataFrame], DataFrame] = lambda rows: rows, cleaned_key: str | None = None) -> DataFrame:
        """All lines an order has in the newest file that holds it, over all committed batches, still with their raw
        status. A later batch is newer, and inside a batch the file that was written last. Lines without an order
        are those of one order. ``clean`` and ``cleaned_key`` are as in ``versions.of_newest_file``."""
        numbers = [r[0] for r in self.manifest().select("Batch").distinct().orderBy("Batch").collect()]
        paths = [f"{self.folder}/batches/{n}" for n in numbers]
        batch = F.regexp_extract("_metadata.file_path", r"/batches/(\d+)/", 1).cast("int")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_batch", batch)
        return versions.of_newest_file(rows, self.order_key, ("_batch", "File_Modified", "File_Source"), clean, cleaned_key).drop("_batch")

    def refresh(self, exports: str, tables_folder: str, others: Mapping[str, DataFrame] | None = None, glob: str = "*.csv") -> list[str]:
        """Ingest, then rebuild the tables from the merged rows; invalid statuses are dropped after merging."""
        self.ingest(exports, glob)
        social = self.current(channels.clean_social_orders, layouts.SOCIAL_ORDERS.get(self.order_key))
        return full_refresh({**(others or {}), "social": social}, tables_folder)
