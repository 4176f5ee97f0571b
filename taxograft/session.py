"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Runtime SQL settings: let Spark re-plan at run time and split skewed join
#: partitions even where that costs one more exchange.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # top_k relies on the limit before the shuffle for any k
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000000",
    # files hold columns packed: a table counts as this many times its files before it is broadcast
    "spark.sql.sources.fileCompressionFactor": "16.0",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "taxograft", cpus: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
