"""Review queries: queue lists, siblings, commands, delayed pushes, protected upserts, orphans, superseding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import flag, iso_utc
from mailspark.operators import review as rv, store as st
from mailspark.queries.views import (CAL_EVENTS, CAL_PUSHES, MAIL_ORDERS, NOW, cal_events, cal_pushes, mail_orders, now,
                                     with_ctes)
from mailspark.sources.tables import load


def review_list(spark: SparkSession, folder: str) -> DataFrame:
    items = rv.review_items(cal_events(spark, folder), mail_orders(spark, folder), limit=100)
    return items.select("id", "title", F.coalesce(iso_utc(F.col("start_ts")), F.lit("")).alias("start_ts"),
                        "review_reason", "evidence", "mail_subject", "mail_from")


def review_page_siblings(spark: SparkSession, folder: str) -> DataFrame:
    page, behind = rv.review_page(cal_events(spark, folder), mail_orders(spark, folder), limit=100)
    return behind.join(page.select("id", "conflicts", "siblings"), "id")


def conflict_siblings(spark: SparkSession, folder: str) -> DataFrame:
    return rv.sibling_counts(cal_events(spark, folder))


def event_status_groups(spark: SparkSession, folder: str) -> DataFrame:
    events = cal_events(spark, folder)
    recent = F.col("created_at") >= now() - F.make_dt_interval(days=F.lit(30))
    parts = [rv.status_filter(events, which).agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("recent")).select(
        F.lit(which).alias("which"), "n", "recent") for which in ("all", "pending", "frozen", "failed", "pushed")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def auto_push_whitelist(spark: SparkSession, folder: str) -> DataFrame:
    return cal_events(spark, folder).select("id", flag(rv.auto_pushable()).alias("auto_pushable"))


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands as typed: id lists, ranges (also backwards), repeats, ids that do not exist."""
    k = F.col("c_custkey")
    kt = k.cast("string")
    text = (F.when(k % 4 == 0, kt).when(k % 4 == 1, F.concat(kt, F.lit(","), (k * 3).cast("string"), F.lit(", "), kt))
            .when(k % 4 == 2, F.concat((k + 3).cast("string"), F.lit("-"), kt))
            .otherwise(F.concat((k + 100000000).cast("string"), F.lit(","), kt)))
    action = F.element_at(F.array(*[F.lit(a) for a in ("approve", "reject", "ignore", "edit", "adopt", "retry")]),
                          (k % 6 + 1).cast("int"))
    return load(spark, folder, "customer").select(
        k.alias("seq"), action.alias("action"), text.alias("event_ids"),
        F.when((k % 6 == 3) & (k % 5 != 0), F.concat(F.lit("edited "), kt)).alias("title"),
        F.when((k % 6 == 3) & (k % 10 > 6), F.lit(NOW).cast("timestamp")).alias("start_ts"))


def expand_ids(spark: SparkSession, folder: str) -> DataFrame:
    return rv.expand_ids(_commands(spark, folder)).select("seq", F.col("pos").cast("long").alias("pos"), "id")


def command_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    _, outcomes = rv.transition(cal_events(spark, folder), rv.expand_ids(_commands(spark, folder)), now())
    return outcomes.select("seq", F.col("pos").cast("long").alias("pos"), "id", "action", "result",
                           F.coalesce("reason", F.lit("")).alias("reason"))


def command_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after the commands: an approval withdraws what was queued for its event."""
    _, outcomes = rv.transition(cal_events(spark, folder), rv.expand_ids(_commands(spark, folder)), now())
    return rv.withdraw_approved(cal_pushes(spark, folder), outcomes).select("id", "event_id", "state")


def command_effects(spark: SparkSession, folder: str) -> DataFrame:
    events, _ = rv.transition(cal_events(spark, folder), rv.expand_ids(_commands(spark, folder)), now())
    return events.select("id", "status", "title", F.coalesce(iso_utc(F.col("start_ts")), F.lit("")).alias("start_ts"),
                         flag(F.col("manual_edited")).alias("manual_edited"),
                         F.col("push_attempts").cast("long").alias("push_attempts"),
                         flag(F.col("needs_attention")).alias("needs_attention"),
                         F.coalesce("managed_state", F.lit("")).alias("managed_state"),
                         F.array_join(F.array_sort(F.map_keys(F.coalesce("field_provenance", F.expr(
                             "cast(map() as map<string,string>)")))), ",").alias("human_fields"))


def push_window_due(spark: SparkSession, folder: str) -> DataFrame:
    return rv.push_window(cal_pushes(spark, folder), cal_events(spark, folder), now(), 60).select(
        "queue_id", "id", iso_utc(F.col("scheduled_for")).alias("scheduled_for"), "title")


def dispatch_due(spark: SparkSession, folder: str) -> DataFrame:
    after = rv.dispatch(cal_pushes(spark, folder), cal_events(spark, folder), now())
    return after.select("id", "event_id", "state", F.coalesce("error", F.lit("")).alias("error"))


def due_first(spark: SparkSession, folder: str) -> DataFrame:
    return rv.due_pushes(cal_pushes(spark, folder), now(), 100).select("id", "event_id")


def schedule_auto(spark: SparkSession, folder: str) -> DataFrame:
    made = rv.schedule(cal_events(spark, folder), cal_pushes(spark, folder), now(), 30)
    return made.select("event_id", iso_utc(F.col("scheduled_for")).alias("scheduled_for"), "state")


def cancel_pushes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    keys = load(spark, folder, "customer").select(F.when(k % 2 == 0, k * 10 + 1).otherwise(k).alias("key"))
    queue, events, _ = rv.cancel_pushes(cal_pushes(spark, folder), cal_events(spark, folder), keys)
    return queue.join(events.select(F.col("id").alias("event_id"), "status"), "event_id").select("id", "state", "status")


def upsert_protected(spark: SparkSession, folder: str) -> DataFrame:
    """A re-run of the extraction: two of three stored events are found again, and as many new ones appear."""
    events = cal_events(spark, folder)
    again = events.where("id % 3 < 2").select(
        "message_id", "fingerprint", F.concat(F.lit("new "), "title").alias("title"), "start_ts", "end_ts", "all_day",
        "source", F.lit(0.5).alias("confidence"), F.lit("found again").alias("evidence"), "location", "organizer", "tz",
        "ics_uid", "ics_sequence", "ics_recurrence_id", "ics_rrule", (F.col("id") % 2 == 0).alias("requires_review"),
        F.lit("why").alias("review_reason"))
    new = again.withColumn("fingerprint", F.concat(F.lit("n"), "fingerprint"))
    after = st.upsert_candidates(events, again.unionByName(new), now())
    return after.select("message_id", "fingerprint", "title", "status", "evidence", "confidence", "outcome",
                        flag(F.col("needs_attention")).alias("needs_attention"))


def orphan_removal(spark: SparkSession, folder: str) -> DataFrame:
    events = cal_events(spark, folder)
    produced = events.where("id % 5 < 3").select("message_id", "fingerprint")
    reprocessed = events.where("message_id % 2 = 0").select("message_id")
    found = st.orphans(events, produced, cal_pushes(spark, folder), reprocessed, llm_usable=False)
    return found.select("id", flag(F.col("removable")).alias("removable"))


def orphans_removed(spark: SparkSession, folder: str) -> DataFrame:
    events, pushes = cal_events(spark, folder), cal_pushes(spark, folder)
    produced = events.where("id % 5 < 3").select("message_id", "fingerprint")
    found = st.orphans(events, produced, pushes, events.select("message_id"), llm_usable=True)
    left, queue = st.remove_orphans(events, pushes, found)
    return left.join(queue.select(F.col("event_id").alias("id"), "state"), "id", "left").select(
        "id", F.coalesce("state", F.lit("none")).alias("state"))


def supersede_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return st.supersede(cal_events(spark, folder)).select("id", "status")


QUERIES = {
    "review_list": review_list, "review_page_siblings": review_page_siblings, "conflict_siblings": conflict_siblings,
    "event_status_groups": event_status_groups, "auto_push_whitelist": auto_push_whitelist, "expand_ids": expand_ids,
    "command_outcomes": command_outcomes, "command_queue": command_queue, "command_effects": command_effects, "push_window_due": push_window_due,
    "dispatch_due": dispatch_due, "due_first": due_first, "schedule_auto": schedule_auto,
    "cancel_pushes": cancel_pushes, "upsert_protected": upsert_protected, "orphan_removal": orphan_removal,
    "orphans_removed": orphans_removed, "supersede_sequence": supersede_sequence,
}

_ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"
_SPLIT = r"""CASE WHEN evidence LIKE '[待审：%' THEN regexp_extract(evidence, '^\[待审：([^\]]*)\]', 1) ELSE '' END AS review_reason,
  trim(regexp_replace(evidence, '^\[待审：[^\]]*\]', '')) AS evidence"""
_PAGE = "page AS (SELECT * FROM cal_events WHERE status = 'pending' ORDER BY start_ts NULLS FIRST, id LIMIT 100)"
_PEERS = """peers AS (SELECT a.id, b.id AS other, b.all_day, abs(epoch(a.start_ts) - epoch(b.start_ts)) > 3600 AND NOT b.all_day AS far
FROM {a} a JOIN cal_events b ON a.message_id = b.message_id AND a.id <> b.id
  AND CAST(a.start_ts + INTERVAL 8 HOUR AS DATE) = CAST(b.start_ts + INTERVAL 8 HOUR AS DATE))"""
_AUTO = """coalesce(NOT needs_attention AND start_ts IS NOT NULL AND ((source = 'ics' AND ics_uid IS NOT NULL)
  OR (source = 'rules' AND confidence > 0.85)), false)"""

_COMMANDS = f"""raw_commands AS (
SELECT c_custkey AS seq, ['approve', 'reject', 'ignore', 'edit', 'adopt', 'retry'][CAST(c_custkey % 6 + 1 AS INTEGER)] AS action,
  CASE WHEN c_custkey % 6 = 3 AND c_custkey % 5 <> 0 THEN 'edited ' || c_custkey END AS new_title,
  CASE WHEN c_custkey % 6 = 3 AND c_custkey % 10 > 6 THEN TIMESTAMP '{NOW}' END AS new_start,
  CASE c_custkey % 4 WHEN 0 THEN [c_custkey] WHEN 1 THEN CASE WHEN c_custkey * 3 = c_custkey THEN [c_custkey] ELSE [c_custkey, c_custkey * 3] END
    WHEN 2 THEN range(c_custkey, c_custkey + 4) ELSE [c_custkey + 100000000, c_custkey] END AS ids
FROM customer),
commands AS (SELECT seq, action, new_title, new_start, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM raw_commands),
ordered AS (SELECT c.*, e.status, seq * 1000 + pos AS place,
  CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'ignore' THEN 'ignored' ELSE 'approved' END AS target,
  CASE WHEN e.id IS NULL THEN false WHEN action IN ('approve', 'reject', 'ignore') THEN status = 'pending'
    WHEN action = 'retry' THEN status IN ('push_failed', 'uncertain', 'missing')
    WHEN action = 'adopt' THEN status IN ('externally_modified', 'conflict')
    ELSE new_title IS NOT NULL OR new_start IS NOT NULL END AS ok
  FROM commands c LEFT JOIN cal_events e ON e.id = c.id),
steps AS (SELECT *, min(CASE WHEN ok THEN place END) OVER (PARTITION BY id) AS first_place,
  min(CASE WHEN ok AND action = 'edit' THEN place END) OVER (PARTITION BY id) AS first_edit,
  arg_min(CASE WHEN ok THEN target END, CASE WHEN ok THEN place END) OVER (PARTITION BY id) AS first_target FROM ordered),
told AS (SELECT *, CASE WHEN first_edit < place THEN 'approved' WHEN first_place < place THEN first_target ELSE status END AS current,
  coalesce(place = first_place, false) OR (ok AND action = 'edit') AS changed FROM steps)"""

ORACLES = {
    "review_list": with_ctes(f"""SELECT p.id, title, coalesce({_ISO.format(x='start_ts')}, '') AS start_ts, {_SPLIT},
  subject AS mail_subject, from_addr AS mail_from FROM page p LEFT JOIN mail_orders m ON m.id = p.message_id""",
                             MAIL_ORDERS, CAL_EVENTS, _PAGE),
    "review_page_siblings": with_ctes("""SELECT id, other, CASE WHEN far THEN 'conflict' ELSE 'sibling' END AS kind,
  count(*) FILTER (far) OVER (PARTITION BY id) AS conflicts, count(*) FILTER (NOT far) OVER (PARTITION BY id) AS siblings
FROM peers""", CAL_EVENTS, _PAGE, _PEERS.format(a="page")),
    "conflict_siblings": with_ctes("""SELECT e.id, count(other) FILTER (far) AS conflicts, count(other) FILTER (NOT far) AS siblings
FROM cal_events e LEFT JOIN peers p ON p.id = e.id WHERE start_ts IS NOT NULL GROUP BY 1""", CAL_EVENTS, _PEERS.format(a="cal_events")),
    "event_status_groups": with_ctes(" UNION ALL ".join(
        f"SELECT '{w}' AS which, count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS recent FROM cal_events WHERE {c}"
        for w, c in (("all", "true"), ("pending", "status = 'pending'"),
                     ("frozen", "status IN ('externally_modified', 'conflict', 'missing')"),
                     ("failed", "status IN ('push_failed', 'uncertain')"), ("pushed", "status = 'pushed'"))), CAL_EVENTS),
    "auto_push_whitelist": with_ctes(f"SELECT id, CASE WHEN {_AUTO} THEN 1 ELSE 0 END AS auto_pushable FROM cal_events", CAL_EVENTS),
    "expand_ids": with_ctes("SELECT seq, pos, id FROM commands", CAL_EVENTS, _COMMANDS),
    "command_outcomes": with_ctes("""SELECT seq, pos, id, action,
  CASE WHEN status IS NULL THEN 'not_found' WHEN changed THEN 'changed' ELSE 'skipped' END AS result,
  CASE WHEN status IS NULL THEN '#' || id || ' 不存在' WHEN changed THEN ''
    WHEN action IN ('approve', 'reject', 'ignore') AND current = target THEN '#' || id || ' 已是 ' || current
    WHEN action = 'retry' THEN '#' || id || ' 当前为 ' || current || '，无需重试'
    WHEN action = 'adopt' THEN '#' || id || ' 当前为 ' || current || '，仅冻结态可 adopt'
    WHEN action = 'edit' THEN '未提供任何要修改的字段' ELSE '#' || id || ' 当前为 ' || current || '，不允许 ' || action END AS reason
FROM told""", CAL_EVENTS, _COMMANDS),
    "command_queue": with_ctes("""SELECT id, event_id, CASE WHEN state = 'queued' AND event_id IN (
  SELECT id FROM told WHERE action = 'approve' AND status IS NOT NULL AND changed) THEN 'cancelled' ELSE state END AS state
FROM cal_pushes""", CAL_EVENTS, CAL_PUSHES, _COMMANDS),
    "command_effects": with_ctes(f"""
, eff AS (SELECT id, arg_min(action, place) FILTER (ok) AS act, min(first_edit) AS first_edit, any_value(first_target) AS ft,
  arg_max(new_title, place) FILTER (ok AND action = 'edit' AND new_title IS NOT NULL) AS nt,
  arg_max(new_start, place) FILTER (ok AND action = 'edit' AND new_start IS NOT NULL) AS ns FROM told WHERE ok GROUP BY id)
SELECT e.id, CASE WHEN first_edit IS NOT NULL THEN 'approved' ELSE coalesce(ft, status) END AS status, coalesce(nt, title) AS title,
  coalesce({_ISO.format(x='coalesce(ns, start_ts)')}, '') AS start_ts, CASE WHEN manual_edited OR first_edit IS NOT NULL THEN 1 ELSE 0 END AS manual_edited,
  CASE WHEN act = 'retry' THEN 0 ELSE push_attempts END AS push_attempts, CASE WHEN needs_attention AND act IS NULL THEN 1 ELSE 0 END AS needs_attention,
  CASE WHEN act = 'adopt' THEN 'adopted' ELSE '' END AS managed_state,
  CASE WHEN act = 'adopt' THEN 'end_ts,location,start_ts,title' ELSE concat_ws(',', CASE WHEN ns IS NOT NULL THEN 'start_ts' END, CASE WHEN nt IS NOT NULL THEN 'title' END) END AS human_fields
FROM cal_events e LEFT JOIN eff USING (id)""".strip(), CAL_EVENTS, _COMMANDS).replace(")\n, eff AS", "),\neff AS"),
    "push_window_due": with_ctes(f"""SELECT p.id AS queue_id, e.id, {_ISO.format(x='scheduled_for')} AS scheduled_for, title
FROM cal_pushes p JOIN cal_events e ON e.id = p.event_id WHERE state = 'queued' AND scheduled_for <= TIMESTAMP '{NOW}' + INTERVAL 60 MINUTE""",
                                 CAL_EVENTS, CAL_PUSHES),
    "dispatch_due": with_ctes(f"""SELECT p.id, event_id,
  CASE WHEN NOT due THEN state WHEN status = 'approved' THEN 'dispatched' ELSE 'cancelled' END AS state,
  CASE WHEN due AND status <> 'approved' THEN '事件状态为 ' || status || '，跳过' ELSE '' END AS error
FROM (SELECT *, state = 'queued' AND scheduled_for <= TIMESTAMP '{NOW}' AS due FROM cal_pushes) p JOIN cal_events e ON e.id = p.event_id""",
                              CAL_EVENTS, CAL_PUSHES),
    "due_first": with_ctes(f"""SELECT id, event_id FROM cal_pushes WHERE state = 'queued' AND scheduled_for <= TIMESTAMP '{NOW}'
ORDER BY scheduled_for, id LIMIT 100""", CAL_PUSHES),
    "schedule_auto": with_ctes(f"""SELECT id AS event_id, '1998-01-01T00:30:00Z' AS scheduled_for, 'queued' AS state FROM cal_events
WHERE {_AUTO} AND status = 'pending' AND id NOT IN (SELECT event_id FROM cal_pushes WHERE state = 'queued')""", CAL_EVENTS, CAL_PUSHES),
    "cancel_pushes": with_ctes("""
, keys AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 + 1 ELSE c_custkey END AS key FROM customer),
hit AS (SELECT DISTINCT coalesce(q.id, e.id) AS id FROM keys LEFT JOIN cal_pushes q ON q.id = key
  LEFT JOIN cal_pushes e ON e.event_id = key AND e.state = 'queued' AND q.id IS NULL WHERE coalesce(q.state, e.state) = 'queued')
SELECT p.id, CASE WHEN h.id IS NOT NULL THEN 'cancelled' ELSE state END AS state,
  CASE WHEN h.id IS NOT NULL AND status = 'approved' THEN 'pending' ELSE status END AS status
FROM cal_pushes p JOIN cal_events c ON c.id = p.event_id LEFT JOIN hit h ON h.id = p.id""".strip(), CAL_EVENTS, CAL_PUSHES).replace(
        ")\n, keys AS", "),\nkeys AS"),
    "upsert_protected": with_ctes(f"""
SELECT message_id, fingerprint, CASE WHEN id % 3 < 2 THEN 'new ' || title ELSE title END AS title,
  CASE WHEN id % 3 < 2 AND NOT prot THEN 'pending' ELSE status END AS status, CASE WHEN id % 3 < 2 THEN 'found again' ELSE evidence END AS evidence,
  CAST(CASE WHEN id % 3 < 2 AND NOT prot THEN 0.5 ELSE confidence END AS DOUBLE) AS confidence,
  CASE WHEN id % 3 = 2 THEN 'kept' WHEN prot THEN 'protected' ELSE 'updated' END AS outcome,
  CASE WHEN id % 3 < 2 AND NOT prot THEN CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END WHEN needs_attention THEN 1 ELSE 0 END AS needs_attention
FROM (SELECT *, status IN {str(lx.PROTECTED_STATUSES)} OR manual_edited AS prot FROM cal_events)
UNION ALL SELECT message_id, 'n' || fingerprint, 'new ' || title, 'pending',
  CASE WHEN id % 2 = 0 THEN '[待审：why] found again' ELSE 'found again' END, CAST(0.5 AS DOUBLE), 'inserted', CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END
FROM cal_events WHERE id % 3 < 2""", CAL_EVENTS),
    "orphan_removal": with_ctes("""SELECT id, CASE WHEN status = 'pending' AND NOT manual_edited AND gcal_event_id IS NULL AND source <> 'llm'
  AND id NOT IN (SELECT event_id FROM cal_pushes WHERE state = 'dispatched') THEN 1 ELSE 0 END AS removable
FROM cal_events WHERE message_id % 2 = 0 AND id % 5 >= 3""", CAL_EVENTS, CAL_PUSHES),
    "orphans_removed": with_ctes("""SELECT e.id, coalesce(state, 'none') AS state FROM cal_events e LEFT JOIN cal_pushes p ON p.event_id = e.id
WHERE NOT (e.id % 5 >= 3 AND status = 'pending' AND NOT manual_edited AND gcal_event_id IS NULL
  AND e.id NOT IN (SELECT event_id FROM cal_pushes WHERE state = 'dispatched'))""", CAL_EVENTS, CAL_PUSHES),
    "supersede_sequence": with_ctes("""SELECT id, CASE WHEN ics_uid IS NOT NULL AND ics_sequence < max(ics_sequence) OVER (PARTITION BY ics_uid, lower(organizer))
  AND status NOT IN ('rejected', 'ignored', 'superseded') THEN 'superseded' ELSE status END AS status FROM cal_events""", CAL_EVENTS),
}
