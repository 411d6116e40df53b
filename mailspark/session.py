"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UTC_CONF = "spark.sql.session.timeZone"
CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "mailspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on. On a cluster the submitter's own settings win.

    Shuffle partition counts are left to adaptive execution: it coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        UTC_CONF: "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; local days are derived explicitly from a named zone."""
    if spark.conf.get(UTC_CONF) != "UTC":
        spark.conf.set(UTC_CONF, "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is named (tests) fall back to a local one."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="mailspark-checkpoint-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(shared)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/reports/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job at a reliable checkpoint that outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(df: DataFrame) -> DataFrame:
    """The side of a join that has a row for every message. Its size is guessed from the compressed files below it, far
    too low for thin rows: such a side meets the other one in the shuffle and is never gathered on the driver."""
    return df.hint("merge")
