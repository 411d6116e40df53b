"""Streaming queries: each runs its stream over the whole table to the end and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.session import pin_utc
from mailspark.streaming import jobs

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.read_stream(pin_utc(spark), folder, "events", _EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(query) -> None:
    query.awaitTermination()


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives, every fourth a second time: the table holds each uid once."""
    stream = event_stream(spark, folder)
    copies = F.when(F.col("event_id") % 4 == 0, 2).otherwise(1)
    twice = stream.withColumn("_n", F.explode(F.sequence(F.lit(1), copies))).select(
        F.lit("a").alias("account"), F.col("event_type").alias("folder"), F.lit(1).cast("long").alias("uid_validity"),
        F.col("event_id").alias("uid"), F.col("ts").alias("received_at"))
    base = jobs.shared_folder(spark, "ingest")
    _finish(jobs.ingest_stream(twice, f"{base}/table", f"{base}/log"))
    return spark.read.parquet(f"{base}/table").groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("uid").alias("uid_sum"))


def stream_delay_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Even events queue an item for later, odd ones withdraw it; time is the last event's."""
    e = F.col("event_id")
    ops = event_stream(spark, folder).select(
        F.floor(e / 2).alias("queue_id"), F.when(e % 2 == 0, "queue").otherwise("cancel").alias("op"),
        F.when(e % 2 == 0, F.col("ts") + F.make_dt_interval(mins=(e % 90).cast("int"))).otherwise(F.col("ts")).alias("at"),
        "ts")
    base = jobs.shared_folder(spark, "queue")
    _finish(jobs.to_batches(jobs.delay_queue(ops), f"{base}/table", f"{base}/log", mode="update"))
    items = jobs.latest_per_key(spark.read.parquet(f"{base}/table"), ["queue_id"])
    states = jobs.queue_states(items, items.agg(F.max("seen")).scalar())
    return states.select("queue_id", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_daily_digest(spark: SparkSession, folder: str) -> DataFrame:
    counts = jobs.daily_counts(event_stream(spark, folder), "ts", by=["event_type"])
    base = jobs.shared_folder(spark, "daily")
    _finish(jobs.to_batches(counts, f"{base}/table", f"{base}/log", mode="update"))
    return jobs.latest_per_key(spark.read.parquet(f"{base}/table"), ["day", "event_type"])


def stream_sliding_audit(spark: SparkSession, folder: str) -> DataFrame:
    counts = jobs.sliding_counts(event_stream(spark, folder), "ts", failed=F.count_if(F.col("event_type") == "error"))
    base = jobs.shared_folder(spark, "audit")
    _finish(jobs.to_batches(counts, f"{base}/table", f"{base}/log", mode="update"))
    latest = jobs.latest_per_key(spark.read.parquet(f"{base}/table"), ["window_end"])
    return latest.select(F.date_format("window_end", "yyyy-MM-dd HH:mm").alias("window_end"), "n", "failed")


QUERIES = {"stream_ingest": stream_ingest, "stream_delay_queue": stream_delay_queue,
           "stream_daily_digest": stream_daily_digest, "stream_sliding_audit": stream_sliding_audit}

ORACLES = {
    "stream_ingest": "SELECT event_type AS folder, count(*) AS n, sum(event_id) AS uid_sum FROM events GROUP BY 1",
    "stream_delay_queue": """
WITH q AS (SELECT event_id // 2 AS queue_id, ts + to_minutes(event_id % 90) AS due FROM events WHERE event_id % 2 = 0),
c AS (SELECT event_id // 2 AS queue_id, ts AS gone FROM events WHERE event_id % 2 = 1),
w AS (SELECT max(ts) AS mark FROM events)
SELECT queue_id, CASE WHEN gone < due THEN 'cancelled' WHEN due < mark THEN 'dispatched' ELSE 'queued' END AS state,
  strftime(CASE WHEN gone < due THEN gone ELSE due END, '%Y-%m-%d %H:%M:%S') AS at
FROM q LEFT JOIN c USING (queue_id), w""",
    "stream_daily_digest": """SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "stream_sliding_audit": """
WITH w AS (SELECT unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS e,
  event_type FROM events)
SELECT strftime(e, '%Y-%m-%d %H:%M') AS window_end, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM w GROUP BY 1""",
}
