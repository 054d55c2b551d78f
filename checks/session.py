"""A local session for tests and benchmarks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from tradewind.session import BUILD_SETTINGS, configure


def local_session(cores: str | int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or 8
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tradewind")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    )
    for key, value in BUILD_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
