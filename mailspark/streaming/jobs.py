"""Streams: exactly-once ingest, the delayed release queue, daily and sliding counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mailspark.operators.ingest import UID_KEY
from mailspark.operators.rules import DEFAULT_ZONE
from mailspark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of one table as they arrive."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", f"{name}*.parquet").parquet(folder))


def to_batches(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
               mode: str = "append") -> StreamingQuery:
    """Each micro-batch into its own folder: a batch that is run again after a failure replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Messages into a table, each uid once: repeats inside a batch and across batches insert nothing.

    The table's keys are read without its texts, and only committed batches of lower number count, so a rerun of
    a batch sees what its first run saw.
    """
    keys = keys or UID_KEY
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(keys)
        if batch_id > 0:
            known = spark.read.parquet(target).where(F.col("batch_id") < batch_id).select(*keys)
            rows = rows.join(known, keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())


# --- the delayed release queue --------------------------------------------------------------------------------

def delay_queue(operations: DataFrame) -> DataFrame:
    """operations (queue_id, op, at, ts) to due, withdrawn and seen of each item, for an update stream: the first
    time it is queued for, the first time it is withdrawn, the last operation's time. No operation is too late."""
    return operations.groupBy("queue_id").agg(
        F.min(F.when(F.col("op") == "queue", F.col("at"))).alias("due"),
        F.min(F.when(F.col("op") == "cancel", F.col("at"))).alias("withdrawn"), F.max("ts").alias("seen"))


def queue_states(items: DataFrame, mark: Column) -> DataFrame:
    """queue_id, state, at of all items ever queued: withdrawn before they were due, released by ``mark``, or queued."""
    pulled = F.coalesce(F.col("withdrawn") < F.col("due"), F.lit(False))
    state = F.when(pulled, "cancelled").when(F.col("due") < mark, "dispatched").otherwise("queued")
    return items.where("due is not null").select("queue_id", state.alias("state"), F.when(
        pulled, F.col("withdrawn")).otherwise(F.col("due")).alias("at"))


# --- windows --------------------------------------------------------------------------------------------------


def daily_counts(messages: DataFrame, ts: str = "received_at", tz: str = DEFAULT_ZONE, lateness: str = "1 day",
                 by: list[str] | None = None) -> DataFrame:
    """Messages per local day: the base of the daily digest."""
    local = F.from_utc_timestamp(F.col(ts), tz)
    return (messages.withColumn("_local", local).withWatermark("_local", lateness)
            .groupBy(F.window("_local", "1 day").alias("w"), *(by or []))
            .agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").cast("string").alias("day"), *(by or []), "n"))


def sliding_counts(messages: DataFrame, ts: str, size: str = "24 hours", step: str = "1 hour", lateness: str = "1 day",
                   **counts: Column) -> DataFrame:
    """Conditional counts over sliding windows: the base of the rolling audit, on receipt or on fetch time."""
    return (messages.withWatermark(ts, lateness).groupBy(F.window(ts, size, step).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
            .select(F.col("w.end").alias("window_end"), "n", *counts))


def latest_per_key(target: DataFrame, keys: list[str]) -> DataFrame:
    """The table an update stream stands for: of each key the row of the latest batch."""
    payload = [c for c in target.columns if c not in (*keys, "batch_id")]
    return target.groupBy(*keys).agg(F.max_by(F.struct(*payload), "batch_id").alias("r")).select(*keys, "r.*")
