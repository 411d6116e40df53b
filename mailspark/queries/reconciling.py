"""Reconcile queries: payload hashes and differences, all-day dates, ownership verdicts, push and removal plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.functions import payload as pl
from mailspark.functions.common import flag, with_once
from mailspark.operators import reconcile as rc
from mailspark.queries.views import CAL_EVENTS, cal_events, now, with_ctes
from mailspark.sources.tables import load


def _payload_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Two JSON payloads per order: what was written, and what the other side holds now."""
    k = F.col("o_orderkey")
    kt = k.cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    mine = F.concat(F.lit('{"summary":"Order '), kt, F.lit('","description":"line one\\nline  two","location":"Room 1","start":{"dateTime":"'),
                    day, F.lit('T02:00:00Z"},"end":{"date":"'), day, F.lit('"},"id":"x","extendedProperties":{"private":{"event_owner_key":"fp'),
                    kt, F.lit('"}}}'))
    theirs = F.concat(
        F.lit('{"etag":"z","start":{"dateTime":"'), day, F.when(k % 4 == 1, "T11:30:00+08:00").otherwise("T10:00:00+08:00"),
        F.lit('"},"summary":"'), F.when(k % 4 == 2, "Moved  ").otherwise("Order  "), kt,
        F.lit('","description":"line one line two",'),
        F.when(k % 4 == 3, "").otherwise('"location":" Room 1 ",'), F.lit('"end":{"date":"'), day,
        F.lit('"},"extendedProperties":{"private":{"event_owner_key":"'), F.when(k % 9 == 0, "other").otherwise("fp"), kt, F.lit('"}}}'))
    return load(spark, folder, "orders").select(k.alias("id"), mine.alias("mine"), theirs.alias("theirs"))


def _formed(spark: SparkSession, folder: str) -> DataFrame:
    return with_once(_payload_pair(spark, folder), a=pl.canonical(pl.parse_payload(F.col("mine"))),
                     b=pl.canonical(pl.parse_payload(F.col("theirs"))))


def payload_hash_diff(spark: SparkSession, folder: str) -> DataFrame:
    found = with_once(_formed(spark, folder), d=pl.diff(F.col("a"), F.col("b")))
    return found.select(
        "id", pl.canonical_json(F.col("a")).alias("canonical"), pl.canonical_hash(F.col("a")).alias("hash"),
        flag(pl.canonical_hash(F.col("a")) == pl.canonical_hash(F.col("b"))).alias("same"),
        F.array_join(F.transform("d", lambda x: x["field"]), ",").alias("fields"),
        pl.describe(F.lit("x"), F.col("d")).alias("detail"))


def stamp_forms(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(k % 5 == 0, F.concat(day, F.lit("T01:02:03+08:00"))).when(k % 5 == 1, F.concat(day, F.lit("T01:02:03Z")))
            .when(k % 5 == 2, F.concat(day, F.lit("T01:02:03"))).when(k % 5 == 3, F.lit("soon 10:20:30")).otherwise(F.lit("")))
    return load(spark, folder, "orders").select(k.alias("id"), pl.normalize_stamp(text).alias("stamp"))


def all_day_dates(spark: SparkSession, folder: str) -> DataFrame:
    first, last = pl.all_day_dates(F.col("start_ts"), F.when(F.col("id") % 3 != 0, F.col("start_ts") + F.make_dt_interval(
        days=(F.col("id") % 4 - 1).cast("int"))), "Asia/Shanghai")
    return cal_events(spark, folder).select("id", first.cast("string").alias("first_day"), last.cast("string").alias("end_day"))


def outbox_payloads(spark: SparkSession, folder: str) -> DataFrame:
    built = rc.local_payloads(cal_events(spark, folder).where("start_ts is not null and not all_day"))
    return built.select("id", "owner_key", "local_payload")


def _remote(spark: SparkSession, folder: str) -> DataFrame:
    """Remote copies of the written events: gone, replaced, same etag, rewritten, edited; and marks of unsent ones."""
    local = rc.local_payloads(_written(spark, folder))
    k = F.col("id")
    kept = local.where("gcal_event_id is not null and id % 7 <> 0").select(
        F.col("gcal_event_id").alias("event_id"),
        F.when(k % 2 == 0, F.col("gcal_etag")).otherwise(F.concat(F.lit("n"), F.col("gcal_etag"))).alias("etag"),
        F.when(k % 5 == 0, F.replace("local_payload", F.lit('"summary":"'), F.lit('"summary":"Edited ')))
        .when(k % 11 == 0, F.replace("local_payload", F.col("owner_key"), F.lit("someone")))
        .otherwise(F.col("local_payload")).alias("payload"))
    marks = local.where("gcal_event_id is null and status = 'approved' and id % 3 = 0").select(
        F.concat(F.lit("found"), k.cast("string")).alias("event_id"), F.lit("m").alias("etag"),
        F.col("local_payload").alias("payload"))
    return kept.unionByName(marks)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the snapshot of their last write; every thirteenth has changed here since."""
    events = cal_events(spark, folder)
    snap = rc.local_payloads(events).select("id", F.col("local_payload").alias("_p"), F.col("local_hash").alias("_h"))
    k = F.col("id")
    joined = events.drop("snapshot_hash", "snapshot_payload").join(snap, "id")
    return joined.withColumns({
        "snapshot_payload": F.when(F.col("gcal_event_id").isNotNull(), F.col("_p")),
        "snapshot_hash": F.when(F.col("gcal_event_id").isNotNull(), F.col("_h")),
        "title": F.when((k % 13 == 0) & F.col("gcal_event_id").isNotNull(), F.concat(F.lit("local "), "title")).otherwise(
            F.col("title"))}).select(*events.columns)


def reconcile_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    local = rc.local_payloads(_written(spark, folder).where("gcal_event_id is not null"))
    judged = rc.compare(local, rc.remote_copies(_remote(spark, folder)))
    return judged.select("id", "verdict", F.array_join(F.transform(F.coalesce("differences", F.expr(
        "cast(array() as array<struct<field:string,mine:string,theirs:string>>)")), lambda d: d["field"]), ",").alias("fields"))


def push_actions(spark: SparkSession, folder: str) -> DataFrame:
    plan = rc.push_plan(_written(spark, folder), _remote(spark, folder), limit=None)
    return plan.select("id", "action")


def push_effects(spark: SparkSession, folder: str) -> DataFrame:
    events = _written(spark, folder)
    plan = rc.push_plan(events, _remote(spark, folder), limit=None)
    sent = plan.where("action in ('create', 'update')").select(
        "id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("event_id"), F.lit("new").alias("etag"),
        F.col("local_hash").alias("remote_hash"))
    after = rc.apply_plan(events, plan, now(), sent)
    return after.select("id", "status", F.coalesce("gcal_event_id", F.lit("")).alias("external_id"),
                        F.coalesce("managed_state", F.lit("")).alias("managed_state"),
                        flag(F.col("needs_attention")).alias("needs_attention"))


def per_run_limit(spark: SparkSession, folder: str) -> DataFrame:
    events = cal_events(spark, folder)
    plan = rc.push_plan(events, _remote(spark, folder), limit=10)
    stats = rc.push_stats(plan).drop("limit_hit")
    waiting = events.where("status = 'approved'").agg(F.count(F.lit(1))).scalar()
    return stats.withColumn("limit_hit", waiting - F.col("considered")).select("considered", "limit_hit")


def removal_actions(spark: SparkSession, folder: str) -> DataFrame:
    events, remote = _written(spark, folder), _remote(spark, folder)
    ids = events.select("id").unionByName(events.where("id < 50").select((F.col("id") + 1000000000).alias("id")))
    soft = rc.removal_plan(events, ids, remote).withColumnRenamed("action", "archive")
    hard = rc.removal_plan(events, ids, remote, hard=True).withColumnRenamed("action", "remove")
    return soft.join(hard, "id").groupBy("archive", "remove").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


def failure_escalation(spark: SparkSession, folder: str) -> DataFrame:
    failures = load(spark, folder, "events").where("event_type = 'error'").select((F.col("event_id") % 5000).alias("id"))
    after = rc.record_failures(cal_events(spark, folder), failures, 3, now())
    return after.select("id", "status", F.col("push_attempts").cast("long").alias("push_attempts"),
                        flag(F.col("needs_attention")).alias("needs_attention"))


QUERIES = {
    "payload_hash_diff": payload_hash_diff, "stamp_forms": stamp_forms, "all_day_dates": all_day_dates,
    "outbox_payloads": outbox_payloads, "reconcile_verdicts": reconcile_verdicts, "push_actions": push_actions,
    "push_effects": push_effects, "per_run_limit": per_run_limit, "removal_actions": removal_actions,
    "failure_escalation": failure_escalation,
}

_CANON = """pairs AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
forms AS (SELECT k, day, 'fp' || k AS own, CASE WHEN k % 9 = 0 THEN 'other' || k ELSE 'fp' || k END AS own2,
  day || 'T02:00' AS st, CASE WHEN k % 4 = 1 THEN day || 'T03:30' ELSE day || 'T02:00' END AS st2,
  'Order ' || k AS su, CASE WHEN k % 4 = 2 THEN 'Moved ' || k ELSE 'Order ' || k END AS su2,
  'Room 1' AS lo, CASE WHEN k % 4 = 3 THEN NULL ELSE 'Room 1' END AS lo2 FROM pairs)"""
_JSON = """'{"description":"line one line two","end":"D:' || day || '","location":"Room 1","owner":"' || own || '","start":"' || st || '","summary":"' || su || '"}'"""

_VERDICT = """base AS (SELECT *, gcal_event_id IS NOT NULL AS sent, CASE WHEN id % 2 = 0 THEN gcal_etag ELSE 'n' || gcal_etag END AS etag,
  id % 13 = 0 AS here, id % 5 = 0 AND (id % 13 <> 0 OR true) AS edited, id % 5 <> 0 AND id % 11 = 0 AS foreign_owner FROM cal_events),
judged AS (SELECT *, CASE WHEN NOT sent THEN NULL WHEN id % 7 = 0 THEN 'not_found' WHEN foreign_owner THEN 'not_owned'
    WHEN etag = gcal_etag THEN 'no_change' WHEN NOT edited AND NOT here THEN 'benign_evolution'
    WHEN here THEN 'conflict' ELSE 'externally_modified' END AS verdict FROM base),
acts AS (SELECT *, CASE WHEN status <> 'approved' THEN NULL WHEN NOT sent THEN CASE WHEN id % 3 = 0 THEN 'backfill' ELSE 'create' END
    WHEN verdict = 'not_found' THEN 'missing' WHEN verdict IN ('not_owned', 'conflict', 'externally_modified') THEN 'freeze'
    WHEN verdict = 'no_change' THEN 'skip' ELSE 'update' END AS action FROM judged)"""

ORACLES = {
    "payload_hash_diff": with_ctes(f"""SELECT k AS id, {_JSON} AS canonical, substr(sha256({_JSON}), 1, 32) AS hash,
  CASE WHEN own = own2 AND k % 4 = 0 THEN 1 ELSE 0 END AS same,
  concat_ws(',', CASE WHEN lo2 IS NULL THEN 'location' END, CASE WHEN own <> own2 THEN 'owner' END, CASE WHEN st <> st2 THEN 'start' END,
    CASE WHEN su <> su2 THEN 'summary' END) AS fields,
  CASE WHEN own = own2 AND k % 4 = 0 THEN 'x' ELSE 'x；差异：' || concat_ws('；',
    CASE WHEN lo2 IS NULL THEN 'location: 我方=''Room 1'' → 远端=None' END, CASE WHEN own <> own2 THEN 'owner: 我方=''' || own || ''' → 远端=''' || own2 || '''' END,
    CASE WHEN st <> st2 THEN 'start: 我方=''' || st || ''' → 远端=''' || st2 || '''' END,
    CASE WHEN su <> su2 THEN 'summary: 我方=''' || su || ''' → 远端=''' || su2 || '''' END) END AS detail FROM forms""", _CANON),
    "stamp_forms": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || 'T17:02'
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02'
  WHEN 3 THEN 'soon 10:20' ELSE '' END AS stamp FROM orders""",
    "all_day_dates": with_ctes("""SELECT id, CAST(f AS VARCHAR) AS first_day, CAST(greatest(coalesce(l, f + 1), f + 1) AS VARCHAR) AS end_day FROM (
  SELECT id, coalesce(CAST(start_ts + INTERVAL 8 HOUR AS DATE), DATE '1970-01-01') AS f,
    CASE WHEN id % 3 <> 0 THEN CAST(start_ts + to_days(CAST(id % 4 - 1 AS INTEGER)) + INTERVAL 8 HOUR AS DATE) END AS l FROM cal_events)""", CAL_EVENTS),
    "outbox_payloads": with_ctes("""SELECT id, fingerprint AS owner_key, '{"summary":"' || title || '","description":"来源：' || evidence
  || '\\n自动创建（' || source || '）","start":{"dateTime":"' || strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') || '","timeZone":"Asia/Shanghai"},"end":{"dateTime":"'
  || strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ') || '","timeZone":"Asia/Shanghai"},"extendedProperties":{"private":{"event_owner_key":"' || fingerprint || '"}}}' AS local_payload
FROM cal_events WHERE start_ts IS NOT NULL AND NOT all_day""", CAL_EVENTS),
    "reconcile_verdicts": with_ctes("""SELECT id, verdict, CASE WHEN verdict IN ('conflict', 'externally_modified') AND (edited OR here) THEN 'summary' ELSE '' END AS fields
FROM judged WHERE sent""", CAL_EVENTS, _VERDICT),
    "push_actions": with_ctes("SELECT id, action FROM acts WHERE action IS NOT NULL", CAL_EVENTS, _VERDICT),
    "push_effects": with_ctes("""SELECT id, CASE WHEN action IN ('create', 'update', 'backfill') THEN 'pushed' WHEN action = 'freeze' AND verdict = 'conflict' THEN 'conflict'
  WHEN action = 'freeze' THEN 'externally_modified' WHEN action = 'missing' THEN 'missing' ELSE status END AS status,
  CASE WHEN action IN ('create', 'update') THEN 'w' || id WHEN action = 'backfill' THEN 'found' || id ELSE coalesce(gcal_event_id, '') END AS external_id,
  CASE WHEN action IN ('create', 'update', 'backfill') THEN 'owned' WHEN action = 'freeze' THEN 'frozen' ELSE '' END AS managed_state,
  CASE WHEN action IN ('create', 'update', 'backfill') THEN 0 WHEN action IN ('freeze', 'missing') THEN 1 WHEN needs_attention THEN 1 ELSE 0 END AS needs_attention
FROM acts""", CAL_EVENTS, _VERDICT),
    "per_run_limit": with_ctes("SELECT least(count(*), 10) AS considered, greatest(count(*) - 10, 0) AS limit_hit FROM cal_events WHERE status = 'approved'", CAL_EVENTS),
    "removal_actions": with_ctes("""SELECT archive, remove, count(*) AS n, sum(id) AS id_sum FROM (
  SELECT id, CASE WHEN NOT sent OR id % 7 = 0 THEN 'cancel_local' WHEN foreign_owner THEN 'refuse' ELSE 'cancel_remote' END AS archive,
    CASE WHEN NOT sent THEN 'refuse' WHEN id % 7 = 0 THEN 'skip' WHEN foreign_owner THEN 'refuse' ELSE 'delete_remote' END AS remove FROM judged
  UNION ALL SELECT id + 1000000000, 'not_found', 'not_found' FROM judged WHERE id < 50) GROUP BY 1, 2""", CAL_EVENTS, _VERDICT),
    "failure_escalation": with_ctes("""
, f AS (SELECT event_id % 5000 AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c.id, CASE WHEN n IS NOT NULL THEN 'push_failed' ELSE status END AS status, push_attempts + coalesce(n, 0) AS push_attempts,
  CASE WHEN n IS NOT NULL THEN CASE WHEN push_attempts + n >= 3 THEN 1 ELSE 0 END WHEN needs_attention THEN 1 ELSE 0 END AS needs_attention
FROM cal_events c LEFT JOIN f USING (id)""".strip(), CAL_EVENTS).replace(")\n, f AS", "),\nf AS"),
}
