"""Mailbox queries: statistics, sender roll-ups, filters, lists, read state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.functions.common import flag, iso_utc
from mailspark.operators import ingest, readstate, stats
from mailspark.queries.views import (CAL_EVENTS, CAL_PUSHES, MAIL_EVENTS, MAIL_ORDERS, cal_events, cal_pushes,
                                     mail_events, mail_orders, sql_any, with_ctes)
from mailspark import lexicon as lx
from mailspark.operators.clusters import noise_components as noise
from mailspark.sources.tables import load


def sender_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.sender_rollup(mail_events(spark, folder)).select(
        "account", "addr", "name", "total", "unread", "replied_count", iso_utc(F.col("last_seen_at")).alias("last_seen_at"),
        flag(F.col("has_unsubscribe")).alias("has_unsubscribe"))


def merged_senders(spark: SparkSession, folder: str) -> DataFrame:
    """The stored roll-up of the even messages, merged with a batch of the odd ones."""
    mail = mail_events(spark, folder)
    stored = ingest.sender_rollup(mail.where("id % 2 = 0"))
    batch = ingest.sender_rollup(mail.where("id % 2 = 1"))
    return ingest.merge_senders(stored, batch).select(
        "account", "addr", "total", "unread", iso_utc(F.col("last_seen_at")).alias("last_seen_at"))


def top_senders(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_senders(ingest.sender_rollup(mail_events(spark, folder)), 20).select("addr", "total")


def noise_clusters(spark: SparkSession, folder: str) -> DataFrame:
    contacts = load(spark, folder, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@d"), (F.col("user_id") % 9).cast("string"),
                 F.lit(".example")).alias("addr"), (F.col("user_id") % 3).alias("replied_count")).distinct()
    found = stats.noise_clusters(mail_events(spark, folder), contacts)
    return found.select("cluster", "messages", "unread", "senders", "with_unsubscribe",
                        iso_utc(F.col("last_seen_at")).alias("last_seen_at"))


def noise_components(spark: SparkSession, folder: str) -> DataFrame:
    """Senders of a few dozen domains; some share a list, some an unsubscribe link that differs in its tracking."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    link = (F.when((e % 11 == 0) & (u % 4 == 0), F.concat(F.lit("https://www.Leave"), text(u % 60), F.lit(".example/u/?id="), text(e)))
            .when((e % 11 == 1) & (u % 6 == 0), F.concat(F.lit("mailto:off"), text(u % 36), F.lit("@x.example?subject="), text(e))))
    mail = load(spark, folder, "events").select(
        F.concat(F.lit("User"), text(u), F.lit("@D"), text(u % 90), F.lit(".example")).alias("from_addr"), link.alias("unsubscribe"),
        F.when((F.col("event_type") == "error") & (u % 5 == 0), F.concat(F.lit("List"), text(u % 45))).alias("list_id"),
        F.when(F.col("value") > 10, F.array(F.lit("\\Seen"))).otherwise(F.expr("cast(array() as array<string>)")).alias("flags"),
        F.col("ts").alias("received_at"))
    contacts = load(spark, folder, "events").where("event_type = 'purchase' and user_id % 7 = 0").select(
        F.concat(F.lit("user"), text(u), F.lit("@d"), text(u % 90), F.lit(".example")).alias("addr"), F.lit(1).alias("replied_count"))
    return noise(mail, contacts).select("cluster", "senders", "messages", "unread", "listed", F.coalesce("target", F.lit("")).alias("target"),
                                        iso_utc(F.col("last_seen_at")).alias("last_seen_at"))


def stats_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    mail, events = mail_orders(spark, folder), cal_events(spark, folder)
    processed = mail_events(spark, folder).select(F.when(F.col("folder") == "error", "fetch_failed").otherwise(
        "synced").alias("status"))
    threads = load(spark, folder, "conversations").select("conv_id").distinct().select(
        F.when(F.col("conv_id") % 5 == 0, None).when(F.col("conv_id") % 5 == 1, "weak").otherwise("strong").alias(
            "link_strength"))
    senders = load(spark, folder, "customer").select(F.col("c_name").alias("addr"))
    runs = load(spark, folder, "supplier").select((F.col("s_suppkey") % 4 != 0).alias("ok"))
    return stats.snapshot(mail, processed, events, cal_pushes(spark, folder), threads, senders, runs)


def mailbox_filters(spark: SparkSession, folder: str) -> DataFrame:
    mail, events = mail_orders(spark, folder), cal_events(spark, folder)
    parts = [stats.mailbox(mail, events, which, limit=None).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("events"), F.max("id").alias("last_id")).select(
        F.lit(which).alias("filter"), "n", "events", "last_id") for which in stats.MAILBOX_FILTERS]
    return reduce(DataFrame.unionByName, parts)


def mailbox_page(spark: SparkSession, folder: str) -> DataFrame:
    page = stats.mailbox(mail_orders(spark, folder), cal_events(spark, folder), "unread", search="UPDATE", limit=300)
    return page.select("id", "subject", "from_addr", "event_count")


def recent_messages(spark: SparkSession, folder: str) -> DataFrame:
    live = mail_orders(spark, folder).where("is_canonical and not stale")
    return live.orderBy(F.desc("received_at"), F.desc("id")).limit(25).select(
        "id", "subject", iso_utc(F.col("received_at")).alias("received_at"))


def message_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its events, one row each."""
    detail = stats.message_detail(mail_orders(spark, folder).select("id", "subject"), cal_events(spark, folder))
    return detail.select("id", "subject", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce(
        "status", F.lit("")).alias("status"))


def labelled_events(spark: SparkSession, folder: str) -> DataFrame:
    return cal_events(spark, folder).groupBy(
        stats.status_label(F.col("status")).alias("status"), stats.source_label(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"))


def mark_read_resolved(spark: SparkSession, folder: str) -> DataFrame:
    chosen = readstate.select_candidates(mail_orders(spark, folder), cal_events(spark, folder), "resolved")
    return chosen.select("id", flag(F.col("already_seen")).alias("already_seen"), "reason")


def mark_read_processed(spark: SparkSession, folder: str) -> DataFrame:
    chosen = readstate.select_candidates(mail_orders(spark, folder), cal_events(spark, folder), "processed")
    return readstate.mark_stats(chosen)


def mark_read_undo(spark: SparkSession, folder: str) -> DataFrame:
    return readstate.undo_candidates(mail_orders(spark, folder)).select("id", "account", "reason")


def epoch_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Live folder epochs against stored ones, a folder being one day of one event type."""
    day = F.date_format("received_at", "yyyy-MM-dd")
    mail = mail_events(spark, folder).withColumn("folder", F.concat("folder", F.lit(" "), day))
    live = mail.groupBy("account", "folder").agg((F.max("uid") % 2).alias("uid_validity"))
    state = mail.where("uid % 3 = 0").groupBy("account", "folder").agg((F.max("uid") % 2).alias("uid_validity"))
    return readstate.guard_epochs(live, state).select("folder", F.coalesce("skipped_reason", F.lit("")).alias("reason"))


QUERIES = {
    "sender_rollup": sender_rollup, "merged_senders": merged_senders, "top_senders": top_senders,
    "noise_clusters": noise_clusters, "noise_components": noise_components, "stats_snapshot": stats_snapshot, "mailbox_filters": mailbox_filters,
    "mailbox_page": mailbox_page, "recent_messages": recent_messages, "message_events": message_events,
    "labelled_events": labelled_events, "mark_read_resolved": mark_read_resolved,
    "mark_read_processed": mark_read_processed, "mark_read_undo": mark_read_undo, "epoch_guard": epoch_guard,
}

_ROLLUP = """SELECT account, lower(from_addr) AS addr, arg_max(from_name, (sent_at, uid)) AS name, count(*) AS total,
  count(*) FILTER (NOT seen) AS unread, 0 AS replied_count, strftime(max(sent_at), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at,
  CASE WHEN bool_or(has_unsubscribe) THEN 1 ELSE 0 END AS has_unsubscribe FROM mail_events GROUP BY 1, 2"""


def _case(column: str, labels: dict[str, str]) -> str:
    return "CASE " + column + " ".join([""] + [f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()]) + " END"


_FILTERS = {
    "all": "true", "unread": "NOT seen", "with_events": "id IN (SELECT message_id FROM cal_events)",
    "no_events": "id NOT IN (SELECT message_id FROM cal_events)", "extract_failed": "extract_status = 'failed'",
    "pending_extract": "extract_status = 'pending'", "marked_by_us": "marked_read_at IS NOT NULL"}
_COUNTED = """counted AS (SELECT m.*, coalesce(n, 0) AS event_count FROM mail_orders m LEFT JOIN
  (SELECT message_id, count(*) AS n FROM cal_events GROUP BY 1) e ON e.message_id = m.id)"""
_DONE = "is_canonical AND NOT stale AND NOT folder_moved AND extract_status = 'done' AND marked_read_at IS NULL"

ORACLES = {
    "sender_rollup": with_ctes(_ROLLUP, MAIL_EVENTS),
    "merged_senders": with_ctes(f"SELECT account, addr, total, unread, last_seen_at FROM ({_ROLLUP})", MAIL_EVENTS),
    "top_senders": with_ctes(f"SELECT addr, total FROM ({_ROLLUP}) ORDER BY total DESC, account, addr LIMIT 20", MAIL_EVENTS),
    "noise_clusters": with_ctes("""
SELECT coalesce(list_id, split_part(lower(from_addr), '@', 2)) AS cluster, count(*) AS messages, count(*) FILTER (NOT seen) AS unread,
  count(DISTINCT lower(from_addr)) AS senders, count(*) FILTER (has_unsubscribe) AS with_unsubscribe,
  strftime(max(received_at), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at
FROM mail_events WHERE lower(from_addr) NOT IN (SELECT 'user' || user_id || '@d' || (user_id % 9) || '.example' FROM events
  WHERE event_type = 'purchase' AND user_id % 3 > 0) GROUP BY 1""", MAIL_EVENTS),
    "noise_components": """
WITH RECURSIVE m AS (SELECT 'user' || user_id || '@d' || (user_id % 90) || '.example' AS node, event_id, user_id, value, ts,
    CASE WHEN event_id % 11 = 0 AND user_id % 4 = 0 THEN 'leave' || (user_id % 60) || '.example/u'
      WHEN event_id % 11 = 1 AND user_id % 6 = 0 THEN 'off' || (user_id % 36) || '@x.example' END AS target,
    CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'list' || (user_id % 45) END AS list
  FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0)),
pairs AS (SELECT DISTINCT node, unnest(list_filter(['t' || target, 'l' || list, 'd' || (user_id % 90)], lambda x: x IS NOT NULL)) AS key FROM m),
reach(node, other) AS (SELECT DISTINCT node, node FROM m
  UNION SELECT r.node, b.node FROM reach r JOIN pairs a ON a.node = r.other JOIN pairs b ON b.key = a.key),
roots AS (SELECT node, min(other) AS cluster FROM reach GROUP BY 1)
SELECT cluster, count(DISTINCT node) AS senders, count(*) AS messages, count(*) FILTER (NOT coalesce(value > 10, false)) AS unread,
  count(list) AS listed, coalesce(min(target), '') AS target, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at
FROM m JOIN roots USING (node) GROUP BY 1""",
    "stats_snapshot": with_ctes("""
SELECT 'messages' AS section, 'total' AS key, count(*) AS n FROM mail_orders
UNION ALL SELECT 'messages', 'with_ics', count(*) FILTER (has_ics) FROM mail_orders
UNION ALL SELECT 'messages', 'with_unsubscribe', count(*) FILTER (has_unsubscribe) FROM mail_orders
UNION ALL SELECT 'messages_by_extract_status', extract_status, count(*) FROM mail_orders GROUP BY 2
UNION ALL SELECT 'senders', 'total', count(*) FROM customer
UNION ALL SELECT 'sync_by_status', CASE WHEN event_type = 'error' THEN 'fetch_failed' ELSE 'synced' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'events_by_status', status, count(*) FROM cal_events GROUP BY 2
UNION ALL SELECT 'events_by_source', source, count(*) FROM cal_events GROUP BY 2
UNION ALL SELECT 'events', 'needs_attention', count(*) FILTER (needs_attention) FROM cal_events
UNION ALL SELECT 'events', 'pending_review', count(*) FILTER (status = 'pending') FROM cal_events
UNION ALL SELECT 'events', 'auto_pushable', count(*) FILTER (status = 'approved') FROM cal_events
UNION ALL SELECT 'pushes', 'pending_window', count(*) FILTER (state = 'queued') FROM cal_pushes
UNION ALL SELECT 'threads', 'total', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'threads_by_strength', CASE conv_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'weak' ELSE 'strong' END, count(DISTINCT conv_id) FROM conversations GROUP BY 2
UNION ALL SELECT 'runs', 'total', count(*) FROM supplier
UNION ALL SELECT 'runs', 'failed', count(*) FILTER (s_suppkey % 4 = 0) FROM supplier""", MAIL_ORDERS, CAL_EVENTS, CAL_PUSHES),
    "mailbox_filters": with_ctes("\nUNION ALL ".join(
        f"SELECT '{k}' AS filter, count(*) AS n, sum(event_count) AS events, max(id) AS last_id FROM counted WHERE {v}"
        for k, v in _FILTERS.items()), MAIL_ORDERS, CAL_EVENTS, _COUNTED),
    "mailbox_page": with_ctes("""SELECT id, subject, from_addr, event_count FROM counted
WHERE NOT seen AND (subject ILIKE '%update%' OR from_addr ILIKE '%update%') ORDER BY received_at DESC, id DESC LIMIT 300""",
                              MAIL_ORDERS, CAL_EVENTS, _COUNTED),
    "recent_messages": with_ctes("""SELECT id, subject, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS received_at
FROM mail_orders WHERE is_canonical AND NOT stale ORDER BY mail_orders.received_at DESC, id DESC LIMIT 25""", MAIL_ORDERS),
    "message_events": with_ctes("""SELECT m.id, subject, coalesce(e.id, -1) AS event_id, coalesce(status, '') AS status
FROM mail_orders m LEFT JOIN cal_events e ON e.message_id = m.id""", MAIL_ORDERS, CAL_EVENTS),
    "labelled_events": with_ctes(f"""SELECT {_case('status', lx.EVENT_STATUS_LABELS)} AS status, {_case('source', lx.SOURCE_LABELS)} AS source,
  count(*) AS n FROM cal_events GROUP BY 1, 2""", CAL_EVENTS),
    "mark_read_resolved": with_ctes(f"""
SELECT id, CASE WHEN seen THEN 1 ELSE 0 END AS already_seen, CASE WHEN seen THEN 'already-seen' WHEN event_count = 0 THEN '无事件（无需处理）'
  ELSE event_count || ' 个事件均已处理完毕' END AS reason
FROM counted WHERE {_DONE} AND id NOT IN (SELECT message_id FROM cal_events WHERE status IN ('pending', 'uncertain', 'push_failed'))
  AND (seen OR NOT {sql_any('lower(subject || chr(10) || from_addr)', lx.ACTIONABLE_SIGNALS)})""", MAIL_ORDERS, CAL_EVENTS, _COUNTED),
    "mark_read_processed": with_ctes(f"""
SELECT account, folder, count(*) AS candidates, count(*) FILTER (seen) AS already_seen, count(*) FILTER (NOT seen) AS to_write
FROM mail_orders WHERE {_DONE} GROUP BY 1, 2""", MAIL_ORDERS),
    "mark_read_undo": with_ctes("""SELECT id, account, '本程序标记过' AS reason FROM mail_orders
WHERE is_canonical AND marked_read_at IS NOT NULL""", MAIL_ORDERS),
    "epoch_guard": with_ctes("""
, f AS (SELECT folder || ' ' || strftime(received_at, '%Y-%m-%d') AS folder, uid FROM mail_events),
a AS (SELECT folder, max(uid) % 2 AS v FROM f GROUP BY 1), b AS (SELECT folder, max(uid) % 2 AS v FROM f WHERE uid % 3 = 0 GROUP BY 1)
SELECT a.folder, CASE WHEN b.v IS NULL THEN '尚无同步记录' WHEN a.v <> b.v THEN
  'UIDVALIDITY 已变化（库中 ' || b.v || ' ≠ 服务端 ' || a.v || '）' ELSE '' END AS reason
FROM a LEFT JOIN b USING (folder)""".strip(), MAIL_EVENTS).replace(")\n, f AS", "),\nf AS"),
}
