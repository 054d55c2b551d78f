"""Small helpers shared by the operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under the operator's own names, so that no further column can clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def bounded_batches(df: DataFrame) -> SparkSession:
    """The session, set to hand Python tasks few rows at a time: texts can be long, and tasks share an executor's memory."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver notice which shuffles no plan refers to any more, so that their files go before the next stage."""
    gc.collect()
    # References that Python has dropped reach the driver's JVM within a second.
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()
