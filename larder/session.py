"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or plans.  Executor counts, memory and the number
# of shuffle partitions belong to the cluster and are left alone.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files hold repeated keys once, rows in memory every time: by its file, a table of ten times the bytes would be broadcast.
    "spark.sql.sources.fileCompressionFactor": "10",
    # Python workers hold a few batches at a time: long texts must not make them large.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "larder") -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
