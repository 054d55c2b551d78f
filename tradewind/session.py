"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. Skewed joins are split even when that costs one more shuffle,
# because a hot order or customer may hold a third of the rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage. A frame that is
# executed once more makes them anew.
RELEASE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# For tables that hold whole rows; a third smaller than Spark's default.
COMPACT = {"compression": "zstd"}

_WHOLE_FILES = {"compression": "gzip", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# To be set when the session is built. Recording the Python line of every Column takes longer than planning
# and running a small query.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def release_shuffles(spark: SparkSession) -> SparkSession:
    """For jobs of many steps, each of which stores its result."""
    for key, value in RELEASE_SHUFFLES.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A temporary local folder is only used in local mode, where driver and executors share a disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tradewind-"))
    return context.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tradewind/{application}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs need the same intermediate result: it cuts the lineage, survives the loss
    of executors and stays columnar, so later jobs read only the columns they use.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str, together: str | None = None) -> Iterator[DataFrame]:
    """``stage`` for rows that nothing reads after the block; they are deleted at its end.

    All rows of one value of the column ``together`` are read by the same task. The files are compressed text then, of which
    Spark does not split any."""
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    if together is None:
        df.write.options(**COMPACT).parquet(path)
    else:
        df.repartition(together).write.options(**_WHOLE_FILES).json(path)
    try:
        reader = spark.read.schema(df.schema)
        yield reader.parquet(path) if together is None else reader.options(**_WHOLE_FILES).json(path)
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application (their readers must be finished)."""
    _delete(spark, f"{shared_folder(spark)}/tradewind/{spark.sparkContext.applicationId}")
