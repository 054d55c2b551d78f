"""Append-only export folders as a stream.

The file source never reads a path twice, so it suits folders whose files do not change; for folders with
rewritten files use the manifest of ``tradewind.plans.refresh.OrderStore``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradewind.operators.versions import newest
from tradewind.plans.months import MonthlyStore


def file_stream(spark: SparkSession, folder: str, schema, file_format: str = "csv", glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, at most ``files_per_batch`` per micro-batch."""
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).withColumns(
        {
            "File_Source": F.col("_metadata.file_name"),
            "File_Modified": F.col("_metadata.file_modification_time"),
            "File_Block": F.col("_metadata.file_block_start"),
        }
    )


def ingest(stream: DataFrame, batches: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store every micro-batch below ``batches``.

    A repeated micro-batch overwrites its own folder, so a restart neither loses nor doubles rows. Without
    ``every`` the query reads what is there and ends; with it (such as "30 minutes") it keeps running.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("File_Row", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{batches}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def current(spark: SparkSession, batches: str, keys, order=("File_Modified", "File_Source")) -> DataFrame:
    """The newest row per key over all stored micro-batches; of two rows in one file the later one."""
    return newest(spark.read.parquet(batches), keys, [*order, "batch", "File_Block", "File_Row"]).drop("batch")


def merge(stream: DataFrame, store: MonthlyStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into a store by month, which holds the newest version of every order and nothing else.

    The state is keyed by order: an older version that arrives late changes nothing, whatever the delay, and a micro-batch that
    a restart repeats is known by its number and not merged again."""

    def write(batch: DataFrame, number: int) -> None:
        store.merge(batch.drop("File_Block"), number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
