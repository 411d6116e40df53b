"""Queries of the streams with state: each runs its stream over the whole table and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.queries.streams import event_stream
from mailspark.queries.views import mail_events
from mailspark.streaming import jobs, stateful as sf


def _sink(spark: SparkSession, name: str, stream: DataFrame) -> DataFrame:
    base = jobs.shared_folder(spark, name)
    sf.run_to_end(stream, lambda s: jobs.to_batches(s, f"{base}/table", f"{base}/log"))
    return spark.read.schema(stream.schema).parquet(f"{base}/table").drop("batch_id")


def arrival_sets(spark: SparkSession, folder: str, mail: DataFrame) -> DataFrame:
    """Mail whose copies share body and message id: what stream and batch both call the same."""
    e = F.col("id")
    body = F.concat(F.lit("b"), ((e - e % 2) % 700).cast("string"))
    return mail.withColumns({"body_sha256": F.sha2(body, 256), "normalized_message_id": F.concat(body, F.lit("@x")),
                             "stale": e % 3 == 0, "folder_moved": e % 8 == 0})


def stream_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the events is stored, some of it asleep; the second half arrives, a tenth of it twice, with
    some uids that are stored."""
    mail = arrival_sets(spark, folder, mail_events(spark, folder))
    half = mail.agg(F.floor(F.max("id") / 2)).scalar()
    stored = mail.where(F.col("id") <= half)
    e = F.col("event_id")
    stream = event_stream(spark, folder).where((e > half) | (e % 100 == 0)).select(
        e.alias("id"), F.lit("a").alias("account"), F.col("event_type").alias("folder"), F.lit(1).cast("long").alias("uid_validity"),
        e.alias("uid"), F.lit(0).cast("long").alias("ord"), F.explode(F.sequence(F.lit(1), F.when(e % 10 == 0, 2).otherwise(1))).alias("_n"))
    verdicts = sf.arrival_verdicts(arrival_sets(spark, folder, stream), stored)
    return _sink(spark, "arrivals", verdicts).select(
        "folder", "uid", "action", F.coalesce("match_id", F.lit(-1)).alias("match_id"),
        F.coalesce("leader_uid", F.lit(-1)).alias("batch_of"))


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return event_stream(spark, folder).select(
        F.floor(e / 2).alias("queue_id"), F.when(e % 2 == 0, "queue").otherwise("cancel").alias("op"),
        F.when(e % 2 == 0, F.col("ts") + F.make_dt_interval(mins=(e % 90).cast("int"))).otherwise(F.col("ts")).alias("at"), "ts")


def stream_release(spark: SparkSession, folder: str) -> DataFrame:
    """Even events queue an item for later, odd ones withdraw it; what event time has not reached is still queued."""
    base = jobs.shared_folder(spark, "release")
    stream = sf.timed_release(_queue(spark, folder))
    sf.run_to_end(stream, lambda s: jobs.to_batches(s, f"{base}/table", f"{base}/log"))
    ended = spark.read.schema(stream.schema).parquet(f"{base}/table").drop("batch_id")
    waiting = sf.still_queued(spark, f"{base}/log").select("queue_id", F.lit("queued").alias("state"), "at")
    return ended.unionByName(waiting).select("queue_id", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_audit_two_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Every message is fetched up to four days after its receipt; some come twice."""
    e = F.col("event_id")
    stream = event_stream(spark, folder).select(
        e.alias("id"), F.col("ts").alias("received_at"), (F.col("ts") + F.make_dt_interval(hours=(e % 100).cast("int"))).alias("fetched_at"),
        "event_type", F.explode(F.sequence(F.lit(1), F.when(e % 7 == 0, 2).otherwise(1))).alias("_n"))
    counts = sf.audit_two_axes(stream, "24 hours", "6 hours", failed=F.col("event_type") == "error")
    return _sink(spark, "axes", counts).select(F.date_format("window_end", "yyyy-MM-dd HH:mm").alias("window_end"), "n", "failed")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = sf.sessions(event_stream(spark, folder), ["user_id"], gap="3 hours", lateness="0 seconds",
                        errors=F.count_if(F.col("event_type") == "error"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _sink(spark, "sessions", found).select("user_id", stamp("start"), stamp("last"), "n", "errors")


def stream_followed(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases with the errors of the same user within 90 minutes after them."""
    events = event_stream(spark, folder).select("user_id", "ts", "event_type")
    found = sf.followed(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), "user_id", 90, "0 seconds")
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return _sink(spark, "followed", found).select("user_id", stamp("first_ts"), stamp("then_ts"))


QUERIES = {"stream_arrivals": stream_arrivals, "stream_release": stream_release, "stream_audit_two_axes": stream_audit_two_axes,
           "stream_sessions": stream_sessions, "stream_followed": stream_followed}

ORACLES = {
    "stream_arrivals": """
WITH m AS (SELECT event_id AS id, event_type AS folder, (event_id - event_id % 2) % 700 AS body, (SELECT max(event_id) // 2 FROM events) AS h FROM events),
stored AS (SELECT *, id % 17 <> 0 AS canonical, id % 3 = 0 OR id % 8 = 0 AS asleep FROM m WHERE id <= h),
come AS (SELECT *, id <= h AS known FROM m WHERE id > h OR id % 100 = 0),
waiting AS (SELECT id, folder, body, row_number() OVER (PARTITION BY folder, body ORDER BY id) AS k FROM stored WHERE asleep),
open AS (SELECT *, row_number() OVER (PARTITION BY folder, body ORDER BY id) AS k FROM come WHERE NOT known),
woken AS (SELECT o.*, w.id AS row FROM open o LEFT JOIN waiting w ON w.folder = o.folder AND w.body = o.body AND w.k = o.k),
rest AS (SELECT r.*, (SELECT min(s.id) FROM stored s WHERE s.canonical AND s.body = r.body) AS dup,
  first_value(id) OVER (PARTITION BY body ORDER BY folder, id) AS lead FROM woken r WHERE row IS NULL)
SELECT folder, id AS uid, 'known' AS action, id AS match_id, -1 AS batch_of FROM come WHERE known
UNION ALL SELECT folder, id, 'reactivated', row, -1 FROM woken WHERE row IS NOT NULL
UNION ALL SELECT folder, id, CASE WHEN dup IS NOT NULL OR lead <> id THEN 'copy' ELSE 'new' END, coalesce(dup, -1),
  CASE WHEN dup IS NULL AND lead <> id THEN lead ELSE -1 END FROM rest""",
    "stream_release": """
WITH q AS (SELECT event_id // 2 AS queue_id, ts + to_minutes(event_id % 90) AS due FROM events WHERE event_id % 2 = 0),
c AS (SELECT event_id // 2 AS queue_id, ts AS gone FROM events WHERE event_id % 2 = 1),
w AS (SELECT max(ts) AS mark FROM events)
SELECT queue_id, CASE WHEN gone < due THEN 'cancelled' WHEN due < mark THEN 'dispatched' ELSE 'queued' END AS state,
  strftime(CASE WHEN gone < due THEN gone ELSE due END, '%Y-%m-%d %H:%M:%S') AS at
FROM q LEFT JOIN c USING (queue_id), w""",
    "stream_audit_two_axes": """
WITH e AS (SELECT event_id, event_type, ts, ts + to_hours(event_id % 100) AS fetched FROM events),
t AS (SELECT event_id, event_type, unnest([ts, fetched]) AS t FROM e),
w AS (SELECT DISTINCT event_id, event_type, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, t, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR,
  time_bucket(INTERVAL 6 HOUR, t, TIMESTAMP '1970-01-01') + INTERVAL 24 HOUR, INTERVAL 6 HOUR)) AS e FROM t),
mark AS (SELECT least(max(ts), max(fetched)) - INTERVAL 1 DAY AS m FROM e)
SELECT strftime(e, '%Y-%m-%d %H:%M') AS window_end, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed
FROM w, mark WHERE e <= m GROUP BY e""",
    "stream_sessions": """
WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS begins FROM events),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS errors
FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)""",
    "stream_followed": """
WITH mark AS (SELECT least((SELECT max(ts) FROM events WHERE event_type = 'purchase'), (SELECT max(ts) FROM events WHERE event_type = 'error')) AS m)
SELECT a.user_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS first_ts, coalesce(strftime(b.ts, '%Y-%m-%d %H:%M:%S'), '') AS then_ts
FROM events a LEFT JOIN events b ON b.event_type = 'error' AND b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 90 MINUTE, mark
WHERE a.event_type = 'purchase' AND (b.ts IS NOT NULL OR a.ts + INTERVAL 90 MINUTE < m)""",
}
