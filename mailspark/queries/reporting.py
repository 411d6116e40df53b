"""Report queries: audit window and suspicion, digest lines, local days, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.functions.common import flag, iso_utc
from mailspark.operators import audit as au, digest as dg, review as rv, stats
from mailspark.operators.rules import rule_candidates, rule_hits
from mailspark.queries.extraction import HITS, VERDICTS, _OPEN
from mailspark.queries.views import (CAL_EVENTS, CAL_PUSHES, MAIL_ORDERS, NOW, cal_events, cal_pushes, mail_orders, now,
                                     with_ctes)
from mailspark.session import checkpointed
from mailspark.sources.sinks import last_run, recent_runs
from mailspark.sources.tables import load

HOURS = 24 * 200


def audit_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = au.window_messages(mail_orders(spark, folder), now(), 48, limit=None)
    return rows.select("id", iso_utc(F.col("received_at")).alias("received_at"), iso_utc(F.col("fetched_at")).alias("fetched_at"))


def audited(spark: SparkSession, folder: str) -> DataFrame:
    rows = au.window_messages(mail_orders(spark, folder), now(), HOURS, limit=None)
    return au.audit_items(rows, cal_events(spark, folder), now())


def audit_suspicion(spark: SparkSession, folder: str) -> DataFrame:
    return audited(spark, folder).select("message_id", "candidates", "missing", "stored", F.col("level").cast("long").alias(
        "level"), F.coalesce("suspicion", F.lit("")).alias("suspicion"))


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return au.audit_counts(audited(spark, folder))


def audit_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return au.audit_lines(audited(spark, folder)).groupBy("section").agg(
        F.count_distinct("message_id").alias("messages"), F.count(F.lit(1)).alias("n_lines"))


def stale_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rule candidates the store lacks: every second one was stored with the same title, some as another all-day entry."""
    mail = mail_orders(spark, folder).withColumnsRenamed({"id": "message_id", "body_excerpt": "text"})
    found = checkpointed(rule_candidates(rule_hits(mail), now()))  # read as candidates and as what is stored
    k = F.col("message_id")
    stored = found.where(k % 2 == 0).select(
        "message_id", "start_ts", "all_day", F.when(k % 3 == 0, F.lit("something else entirely")).otherwise(F.col("title")).alias(
            "title"), F.when(k % 10 == 0, "llm").otherwise("rules").alias("source"))
    return au.missing_candidates(found, stored).groupBy("message_id").agg(F.count(F.lit(1)).alias("missing"))


def digest_split_days(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit("2024-01-15 03:00:00").cast("timestamp")
    entries = load(spark, folder, "events").select(
        F.col("ts").alias("start_ts"), (F.col("event_id") % 5 == 0).alias("all_day"), F.concat(
            F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("summary"))
    return dg.split_days(entries, at)


def calendar_listing(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit('{"summary":"s'), k.cast("string"), F.lit('","status":"'), F.when(k % 5 == 0, "cancelled").otherwise(
        "confirmed"), F.lit('","start":{"'), F.when(k % 3 == 0, F.concat(F.lit('date":"'), day)).otherwise(
        F.concat(F.lit('dateTime":"'), day, F.lit("T20:30:00+08:00"))), F.lit('"}}'))
    payloads = load(spark, folder, "orders").select(k.cast("string").alias("event_id"), text.alias("payload"))
    return dg.calendar_entries(payloads).select("summary", iso_utc(F.col("start_ts")).alias("start_ts"), flag(
        F.col("all_day")).alias("all_day"))


def relative_times(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit("2024-01-15 03:00:00").cast("timestamp")
    return load(spark, folder, "events").select(
        F.col("event_id").alias("id"), dg.relative_text(F.col("ts"), at).alias("ago"),
        dg.when_text(F.col("ts"), F.col("event_id") % 2 == 0).alias("shown"))


def digest_daily(spark: SparkSession, folder: str) -> DataFrame:
    mail, events, pushes = mail_orders(spark, folder), cal_events(spark, folder), cal_pushes(spark, folder)
    window = rv.push_window(pushes, events, now(), 120)
    none = spark.createDataFrame([], "id long, subject_norm string, link_strength string, last_message_at timestamp, n long")
    figures = stats.count_by(mail, "extract_status", "messages_by_extract_status").unionByName(
        stats.count_by(events, "status", "events_by_status"))
    return dg.digest_lines(now(), figures, events, window, mail, none)


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    runs = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderstatus").alias("command"))
    return recent_runs(runs, 20).unionByName(last_run(runs).withColumn("command", F.lit("last")))


QUERIES = {
    "audit_window": audit_window, "audit_suspicion": audit_suspicion, "audit_counts": audit_counts,
    "audit_report_lines": audit_report_lines, "stale_results": stale_results, "digest_split_days": digest_split_days,
    "calendar_listing": calendar_listing, "relative_times": relative_times, "digest_daily": digest_daily, "run_log": run_log,
}

_IN = f"(({{c}} BETWEEN TIMESTAMP '{NOW}' - to_hours({{h}}) AND TIMESTAMP '{NOW}'))"


def _window(hours: int) -> str:
    return "is_canonical AND (" + _IN.format(c="received_at", h=hours) + " OR " + _IN.format(c="fetched_at", h=hours) + ")"


# in the audit the calendar mark is not trusted: only the stored text is read again
_AUDIT_MAIL = MAIL_ORDERS.replace("o_orderkey % 97 = 0 AS has_ics", "false AS has_ics")
_ITEMS = f"""slots AS (SELECT DISTINCT message_id, CAST(local_ts AS DATE) AS day, CASE WHEN all_day THEN NULL ELSE local_ts END AS slot, all_day, start_ts FROM (
  SELECT *, bool_or(NOT all_day) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS day_timed FROM (
    SELECT *, is_deadline OR NOT has_time AS all_day, start_ts + INTERVAL 8 HOUR AS local_ts FROM hits)) WHERE NOT (all_day AND day_timed)),
cand AS (SELECT message_id, count(DISTINCT (day, slot)) AS n FROM slots GROUP BY 1),
lacking AS (SELECT message_id, count(*) AS n FROM slots s WHERE message_id NOT IN (SELECT message_id FROM cal_events WHERE source = 'llm')
  AND NOT (all_day AND EXISTS (SELECT 1 FROM cal_events e WHERE e.message_id = s.message_id AND e.source <> 'llm' AND e.all_day
    AND CAST(e.start_ts AS DATE) = CAST(s.start_ts AS DATE))) GROUP BY 1),
kept AS (SELECT message_id, count(*) AS n FROM cal_events GROUP BY 1),
items AS (SELECT v.id AS message_id, coalesce(c.n, 0) AS candidates, coalesce(l.n, 0) AS missing, coalesce(k.n, 0) AS stored, kind, extract_status,
  kind = 'yes' AND len(event) > 0 AND NOT paired AS call_llm, has_date AND has_time AS shapes
  FROM verdicts v LEFT JOIN cand c ON c.message_id = v.id LEFT JOIN lacking l ON l.message_id = v.id LEFT JOIN kept k ON k.message_id = v.id
  WHERE {_window(HOURS)}),
told AS (SELECT *, CASE WHEN extract_status = 'failed' THEN CASE WHEN candidates > 0 THEN 2 ELSE 1 END WHEN missing > 0 THEN 2
    WHEN kind = 'yes' AND candidates = 0 THEN CASE WHEN call_llm THEN 0 ELSE 2 END WHEN kind <> 'yes' AND shapes THEN 1 ELSE 0 END AS level,
  CASE WHEN extract_status = 'failed' THEN CASE WHEN candidates > 0 THEN '上次抽取失败；当前代码能抽出 ' || candidates || ' 条候选' ELSE '该邮件上次抽取失败，且当前代码仍未抽出候选' END
    WHEN missing > 0 THEN '库中结果已过时：当前代码会多抽出 ' || missing || ' 条候选'
    WHEN kind = 'yes' AND candidates = 0 THEN CASE WHEN call_llm THEN '' ELSE '预筛判定规则足以覆盖（未调用 LLM），但规则未命中任何时间' END
    WHEN kind <> 'yes' AND shapes THEN '被预筛过滤，但正文含日期与时刻形态' ELSE '' END AS suspicion FROM items)"""
AUDIT_CTES = (_AUDIT_MAIL, VERDICTS, _OPEN, HITS, CAL_EVENTS, _ITEMS)
_AGO = "epoch(TIMESTAMP '2024-01-15 03:00:00') - floor(epoch(ts))"

ORACLES = {
    "audit_window": with_ctes(f"""SELECT id, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS received_at,
  strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at FROM mail_orders WHERE {_window(48)}""", MAIL_ORDERS),
    "audit_suspicion": with_ctes("SELECT message_id, candidates, missing, stored, level, suspicion FROM told", *AUDIT_CTES),
    "audit_counts": with_ctes("""SELECT count(*) AS messages, count(*) FILTER (level = 2) AS likely_missed, count(*) FILTER (level = 1) AS maybe,
  count(*) FILTER (candidates > 0) AS with_candidates, count(*) FILTER (missing > 0) AS stale, count(*) FILTER (call_llm AND candidates = 0) AS unjudged FROM told""", *AUDIT_CTES),
    "audit_report_lines": with_ctes("""SELECT CASE WHEN level > 0 THEN '1-suspect' WHEN candidates > 0 THEN '2-found' ELSE '3-quiet' END AS section,
  count(*) AS messages, sum(CASE WHEN level > 0 THEN 6 WHEN candidates > 0 THEN 4 ELSE 1 END) AS n_lines FROM told GROUP BY 1""", *AUDIT_CTES),
    "stale_results": with_ctes("""SELECT message_id, count(*) AS missing FROM (SELECT *, is_deadline OR NOT has_time AS all_day FROM hits)
WHERE message_id % 2 = 1 OR (message_id % 3 = 0 AND message_id % 10 <> 0 AND NOT all_day) GROUP BY 1""", MAIL_ORDERS, "src AS (SELECT * FROM mail_orders)", HITS),
    "digest_split_days": """
WITH e AS (SELECT event_type || ' ' || event_id AS summary, event_id % 5 = 0 AS all_day, ts + INTERVAL 8 HOUR AS l FROM events)
SELECT CASE WHEN CAST(l AS DATE) = DATE '2024-01-15' THEN 'today' ELSE 'upcoming' END AS bucket, CAST(CAST(l AS DATE) AS VARCHAR) AS day,
  CASE WHEN CAST(l AS DATE) = DATE '2024-01-15' THEN '' ELSE strftime(l, '%m-%d ') END || CASE WHEN all_day THEN '全天' ELSE strftime(l, '%H:%M') END AS "when",
  summary FROM e WHERE CAST(l AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-22'""",
    "calendar_listing": """SELECT 's' || o_orderkey AS summary, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 8 HOUR
  ELSE o_orderdate + INTERVAL 750 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS all_day
FROM orders WHERE o_orderkey % 5 <> 0""",
    "relative_times": f"""SELECT event_id AS id, CASE WHEN {_AGO} < 0 THEN strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M') WHEN {_AGO} < 60 THEN '刚刚'
  WHEN {_AGO} < 3600 THEN CAST(floor(({_AGO}) / 60) AS BIGINT) || ' 分钟前' WHEN {_AGO} < 86400 THEN CAST(floor(({_AGO}) / 3600) AS BIGINT) || ' 小时前'
  WHEN {_AGO} < 604800 THEN CAST(floor(({_AGO}) / 86400) AS BIGINT) || ' 天前' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS ago,
  CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') || ' 全天' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END AS shown FROM events""",
    "digest_daily": with_ctes(f"""
, ev AS (SELECT *, '- `#' || id || '` ' || CASE WHEN start_ts IS NULL THEN '（无时间）' WHEN all_day THEN strftime(start_ts + INTERVAL 8 HOUR, '%Y-%m-%d') || ' 全天'
  ELSE strftime(start_ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END || ' · ' || title AS line FROM cal_events),
parts AS (
 (SELECT 'window' AS section, row_number() OVER (ORDER BY scheduled_for, p.id) - 1 AS ord, line FROM cal_pushes p JOIN ev ON ev.id = event_id
   WHERE state = 'queued' AND scheduled_for <= TIMESTAMP '{NOW}' + INTERVAL 120 MINUTE ORDER BY ord LIMIT 25)
 UNION ALL (SELECT 'pending', row_number() OVER (ORDER BY start_ts NULLS FIRST, id) - 1 AS ord, line FROM ev WHERE status = 'pending' ORDER BY ord LIMIT 25)
 UNION ALL (SELECT 'attention', row_number() OVER (ORDER BY CASE WHEN status IN ('externally_modified', 'conflict') THEN 0 ELSE 1 END, start_ts NULLS FIRST, id) - 1 AS ord,
   '[' || status || '] ' || line FROM ev WHERE status IN ('externally_modified', 'conflict', 'push_failed', 'uncertain') ORDER BY ord LIMIT 50)
 UNION ALL (SELECT 'messages', row_number() OVER (ORDER BY received_at DESC, id DESC) - 1 AS ord, '- ' || strftime(received_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')
   || ' · ' || subject || CASE WHEN has_ics THEN ' 📅' ELSE '' END || ' — ' || CASE WHEN length(from_addr) > 30 THEN substr(from_addr, 1, 30) || '…' ELSE from_addr END
   FROM mail_orders WHERE is_canonical AND NOT stale ORDER BY ord LIMIT 15)
 UNION ALL (SELECT 'system', row_number() OVER (ORDER BY s, k) - 1, '- ' || s || ' ' || k || '：' || n FROM (
   SELECT 'messages_by_extract_status' AS s, extract_status AS k, count(*) AS n FROM mail_orders GROUP BY 2
   UNION ALL SELECT 'events_by_status', status, count(*) FROM cal_events GROUP BY 2))
 UNION ALL (SELECT 'notes', 0, '> ⚠️ 有 ' || count(*) || ' 封邮件停留在「抽取中」状态。' FROM mail_orders WHERE extract_status = 'running' HAVING count(*) > 0))
SELECT '1998-01-01' AS digest_date, section, ord, line FROM parts""".strip(), MAIL_ORDERS, CAL_EVENTS, CAL_PUSHES).replace(")\n, ev AS", "),\nev AS"),
    "run_log": """(SELECT o_orderkey AS id, 'r' || o_orderkey AS run_id, o_orderstatus AS command FROM orders ORDER BY o_orderkey DESC LIMIT 20)
UNION ALL (SELECT o_orderkey, 'r' || o_orderkey, 'last' FROM orders ORDER BY o_orderkey DESC LIMIT 1)""",
}
