"""Table scans with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.schema import TABLES
from mailspark.session import pin_utc


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; stamps without a zone are read as UTC instants."""
    df = pin_utc(spark).read.parquet(f"{folder}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Parts of at most some ``rows`` rows for costly per-row work, one for each core at least: a larger input has more
    tasks, not longer ones. An input of enough splits passes unchanged."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def state_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the fixed-schema state tables."""
    return pin_utc(spark).read.schema(TABLES[name]).parquet(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
