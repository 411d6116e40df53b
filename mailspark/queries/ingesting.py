"""Ingest queries: cursors, epochs, copies, moves, ledger, claiming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.functions.common import flag, iso_utc
from mailspark.operators import ingest as ig, reread
from mailspark.operators.stats import first_errors, sync_stats, worst_exit
from mailspark.queries.views import MAIL_EVENTS, NOW, mail_events, mail_orders, MAIL_ORDERS, now, with_ctes
from mailspark.sources.tables import load
from mailspark.streaming.jobs import shared_folder

_ORDER = ("click", "error", "purchase", "signup", "view")


def _folders(mail: DataFrame) -> DataFrame:
    """Live folder states: one folder in another epoch, one folder where the next uid shows nothing new."""
    rank = F.coalesce(*[F.when(F.col("folder") == f, F.lit(i)) for i, f in enumerate(_ORDER)], F.lit(9))
    return mail.groupBy("account", "folder").agg((F.max("uid") + 1).alias("uid_next")).select(
        "account", "folder", F.lit(1).cast("long").alias("uid_validity"), "uid_next", rank.alias("folder_ord"))


def _state(mail: DataFrame) -> DataFrame:
    """Stored cursors at the first third of each folder's uids; one folder was stored in an older epoch, one is new,
    one is complete."""
    top = mail.groupBy("account", "folder").agg(F.max("uid").alias("top"))
    return top.where("folder <> 'signup'").select(
        "account", "folder", F.when(F.col("folder") == "error", 7).otherwise(1).cast("long").alias("uid_validity"),
        F.when(F.col("folder") == "view", F.col("top")).otherwise(F.floor(F.col("top") / 3)).cast("long").alias(
            "highest_uid"), F.lit(4).alias("syncs_since_full"),
        F.lit("1997-12-31 00:00:00").cast("timestamp").alias("last_sync_at"),
        F.lit(None).cast("timestamp").alias("last_full_sync_at"))


def incremental_cursor(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder)
    state = _state(mail)
    cursors = ig.folder_cursor(_folders(mail), state)
    after = ig.advance(state, cursors, ig.new_uids(mail, cursors), now())
    return after.select("folder", "uid_validity", "highest_uid", F.col("syncs_since_full").cast("long").alias(
        "syncs_since_full"), F.coalesce(iso_utc(F.col("last_full_sync_at")), F.lit("")).alias("last_full_sync_at"))


def incremental_taken(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder)
    return ig.new_uids(mail, ig.folder_cursor(_folders(mail), _state(mail))).groupBy("folder").agg(
        F.count(F.lit(1)).alias("taken"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"))


def budget_across_folders(spark: SparkSession, folder: str) -> DataFrame:
    """A per-run limit that is used up inside the second folder: its cursor stops at the last uid taken."""
    mail = mail_events(spark, folder)
    state = _state(mail)
    cursors = ig.folder_cursor(_folders(mail), state)
    after = ig.advance(state, cursors, ig.new_uids(mail, cursors, budget=2000), now())
    return after.select("folder", "highest_uid")


def compensation_due(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    state = load(spark, folder, "customer").select(
        F.lit("a").alias("account"), F.col("c_name").alias("folder"), (k % 25).cast("int").alias("syncs_since_full"),
        F.when(k % 3 != 0, now() - F.make_dt_interval(hours=(k % 50).cast("int"))).alias("last_full_sync_at"))
    return ig.compensation_due(state, now(), scans=20).select("folder", flag(F.col("due")).alias("due"))


def compensating_reread(spark: SparkSession, folder: str) -> DataFrame:
    """Every 37th message was lost below the cursor; due folders read the last 20 days of the raw store again."""
    mail = mail_events(spark, folder).withColumn("received_day", F.to_date("received_at"))
    path = shared_folder(spark, "raw")
    (mail.select("account", "folder", "uid_validity", "uid", "received_at", "received_day")
     .repartition("received_day").write.partitionBy("received_day").parquet(path))
    state = _state(mail).withColumn("syncs_since_full", F.when(F.col("folder").isin("click", "view"), 20).otherwise(3))
    due = ig.compensation_due(state, now(), scans=20).where("due")
    since = mail.agg(F.date_sub(F.max("received_day"), 19)).scalar()
    raw = spark.read.parquet(path)
    return reread.lost_messages(raw, mail.where("id % 37 <> 0"), due, since).select("folder", "uid")


def epoch_stale(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder)
    marked = ig.mark_stale(mail.withColumn("stale", F.col("id") % 50 == 0), ig.folder_cursor(_folders(mail), _state(mail)))
    return marked.groupBy("folder").agg(F.count_if("stale").alias("stale"), F.count_if(~F.col("stale")).alias("live"))


def moved_messages(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder).withColumn("folder_moved", F.col("id") % 40 == 0)
    present = mail.where("uid % 9 <> 0 and folder <> 'view'")
    return ig.mark_moved(mail, present).groupBy("folder").agg(F.count_if("folder_moved").alias("moved"))


def _arrival_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows are the first half of the events, some asleep; the second half arrives, a few of it twice."""
    mail = mail_events(spark, folder)
    half = mail.agg(F.floor(F.max("id") / 2)).scalar()
    stored = mail.where(F.col("id") <= half).withColumns({
        "stale": F.col("id") % 3 == 0, "folder_moved": F.col("id") % 8 == 0,
        "moved_to_folder": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast("long")})
    later = mail.where(F.col("id") > half)
    again = mail.where((F.col("id") <= half) & (F.col("id") % 100 == 0))
    arrivals = later.unionByName(later.where("id % 10 = 0")).unionByName(again)
    return stored, arrivals.drop("id", "is_canonical", "extract_status", "extract_attempts")


def arrival_actions(spark: SparkSession, folder: str) -> DataFrame:
    stored, arrivals = _arrival_sets(spark, folder)
    decided = ig.classify_arrivals(arrivals, stored)
    return decided.select("folder", "uid", "action", F.coalesce("match_id", F.lit(-1)).alias("match_id"),
                          F.coalesce("batch_of", F.lit(-1)).alias("batch_of"))


def reactivate_moved(spark: SparkSession, folder: str) -> DataFrame:
    stored, arrivals = _arrival_sets(spark, folder)
    after = ig.apply_arrivals(stored, ig.classify_arrivals(arrivals, stored), now())
    return after.groupBy("folder", "extract_status", "stale", "is_canonical").agg(
        F.count(F.lit(1)).alias("n"), F.sum("uid").alias("uid_sum")).select(
        "folder", "extract_status", flag(F.col("stale")).alias("stale"), flag(F.col("is_canonical")).alias("is_canonical"),
        "n", "uid_sum")


def ingest_ledger(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder)
    e = F.col("id")

    def log(df: DataFrame, shift: int) -> DataFrame:
        failed = (e + shift) % 4 == 0
        return df.select("account", "folder", "uid_validity", "uid",
                         F.when(failed, "fetch_failed").otherwise("synced").alias("status"),
                         F.when(failed, F.concat(F.lit("err"), F.lit(str(shift)))).alias("error"),
                         (F.col("received_at") + F.make_dt_interval(hours=F.lit(shift))).alias("processed_at"))

    stored = log(mail, 0)
    batch = log(mail.where("id % 3 = 0"), 1).unionByName(log(mail.where("id % 6 = 0"), 2))
    return ig.ledger(stored, batch).select("uid", "status", F.coalesce("error", F.lit("")).alias("error"))


def claim_reclaim(spark: SparkSession, folder: str) -> DataFrame:
    after = ig.reclaim(mail_orders(spark, folder), now(), zombie_minutes=60, max_attempts=4)
    return after.select("id", "extract_status")


def claim_next(spark: SparkSession, folder: str) -> DataFrame:
    return ig.claim(mail_orders(spark, folder), 200, "a1").select("id", "extract_status")


def attempt_results(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_orders(spark, folder)
    after = ig.after_attempt(mail, mail.where("id % 2 = 0").select("id"), 3)
    return after.select("id", "extract_status", F.col("extract_attempts").cast("long").alias("extract_attempts"))


def contact_replies(spark: SparkSession, folder: str) -> DataFrame:
    turns = load(spark, folder, "conversations").select(
        F.lit("a").alias("account"), F.col("conv_id").alias("thread_id"), F.concat(F.col("role"), (F.col("conv_id") % 5).cast(
            "string")).alias("from_addr"), F.timestamp_seconds(F.col("turn") * 60).alias("received_at"))
    return ig.replied_counts(turns, [f"assistant{i}" for i in range(5)])


def sync_rollup(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_events(spark, folder)
    folders = mail.groupBy("folder").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("is_canonical").alias("inserted"),
        F.count_if(~F.col("is_canonical")).alias("duplicated"), F.max(F.when(
            F.col("folder") == "error", F.lit("lost"))).alias("error"))
    return sync_stats(folders).withColumn("has_errors", flag(F.col("has_errors")))


def run_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = mail_events(spark, folder).where("folder = 'error'").select("id", F.concat(F.lit("#"), F.col("id").cast(
        "string"), F.lit(" failed")).alias("text"))
    stages = mail_events(spark, folder).select((F.col("id") % 3).cast("int").alias("exit_code"), F.lit(False).alias(
        "lock_missed"))
    return first_errors(errors, "id", "text", 10).select(F.array_join("errors", ";").alias("errors")).withColumn(
        "exit_code", worst_exit(stages).scalar().cast("long"))


QUERIES = {
    "incremental_cursor": incremental_cursor, "incremental_taken": incremental_taken,
    "budget_across_folders": budget_across_folders, "compensation_due": compensation_due, "compensating_reread": compensating_reread, "epoch_stale": epoch_stale,
    "moved_messages": moved_messages, "arrival_actions": arrival_actions, "reactivate_moved": reactivate_moved,
    "ingest_ledger": ingest_ledger, "claim_reclaim": claim_reclaim, "claim_next": claim_next,
    "attempt_results": attempt_results, "contact_replies": contact_replies, "sync_rollup": sync_rollup,
    "run_errors": run_errors,
}

_CURSORS = """tops AS (SELECT folder, max(uid) AS top FROM mail_events GROUP BY 1),
cursors AS (SELECT folder, top, CASE folder WHEN 'error' THEN 0 WHEN 'signup' THEN 0 WHEN 'view' THEN top ELSE top // 3 END AS cur,
  CASE WHEN folder IN ('error', 'signup') THEN 0 ELSE 4 END AS syncs FROM tops),
taken AS (SELECT m.folder, uid, list_position(['click', 'error', 'purchase', 'signup', 'view'], m.folder) AS ord
  FROM mail_events m JOIN cursors c USING (folder) WHERE uid > cur)"""
_ARRIVE = """half AS (SELECT max(id) // 2 AS h FROM mail_events),
stored AS (SELECT *, id % 3 = 0 AS stale, id % 8 = 0 AS moved FROM mail_events, half WHERE id <= h),
arrivals AS (SELECT * FROM mail_events, half WHERE id > h OR id % 100 = 0),
matched AS (SELECT a.*, k.id AS known,
  least((SELECT min(id) FROM stored s WHERE is_canonical AND s.body = a.body),
        (SELECT min(id) FROM stored s WHERE is_canonical AND s.mid = a.mid)) AS dup
  FROM arrivals a LEFT JOIN stored k ON k.folder = a.folder AND k.uid = a.uid),
-- every sleeping row is taken once: the k-th arrival of a body takes the k-th row of that body, then the same by id
asleep AS (SELECT *, row_number() OVER (PARTITION BY folder, body ORDER BY id) AS k FROM stored WHERE stale OR moved),
come AS (SELECT *, row_number() OVER (PARTITION BY folder, body ORDER BY uid) AS k FROM matched WHERE known IS NULL),
by_body AS (SELECT c.folder, c.uid, a.id AS reuse FROM come c JOIN asleep a ON a.folder = c.folder AND a.body = c.body AND a.k = c.k),
asleep2 AS (SELECT *, row_number() OVER (PARTITION BY folder, mid ORDER BY id) AS k2 FROM asleep
  WHERE id NOT IN (SELECT reuse FROM by_body) AND length(mid) > 0),
come2 AS (SELECT c.*, row_number() OVER (PARTITION BY folder, mid ORDER BY uid) AS k2 FROM come c
  ANTI JOIN by_body b ON b.folder = c.folder AND b.uid = c.uid WHERE length(mid) > 0),
taken_rows AS (SELECT * FROM by_body UNION ALL
  SELECT c.folder, c.uid, a.id FROM come2 c JOIN asleep2 a ON a.folder = c.folder AND a.mid = c.mid AND a.k2 = c.k2),
reused AS (SELECT m.*, t.reuse FROM matched m LEFT JOIN taken_rows t ON t.folder = m.folder AND t.uid = m.uid),
base AS (SELECT *, CASE WHEN known IS NOT NULL THEN 'known' WHEN reuse IS NOT NULL THEN 'reactivated' WHEN dup IS NOT NULL THEN 'copy' ELSE 'new' END AS act
  FROM reused),
firsts AS (SELECT b.*, (SELECT min((f.folder, f.uid)) FROM base f WHERE f.act = 'new' AND (f.body = b.body OR f.mid = b.mid)) AS fst FROM base b),
decided AS (SELECT *, act = 'new' AND fst < (folder, uid) AS twin FROM firsts)"""

ORACLES = {
    "incremental_cursor": with_ctes(f"""SELECT folder, 1 AS uid_validity, top AS highest_uid, syncs + 1 AS syncs_since_full,
  CASE WHEN folder = 'error' THEN '1998-01-01T00:00:00Z' ELSE '' END AS last_full_sync_at FROM cursors""", MAIL_EVENTS, _CURSORS),
    "incremental_taken": with_ctes("SELECT folder, count(*) AS taken, min(uid) AS first_uid, max(uid) AS last_uid FROM taken GROUP BY 1",
                                   MAIL_EVENTS, _CURSORS),
    "budget_across_folders": with_ctes("""SELECT c.folder, greatest(cur, coalesce(max(t.uid), 0)) AS highest_uid FROM cursors c
LEFT JOIN (SELECT * FROM taken ORDER BY ord, uid LIMIT 2000) t USING (folder) GROUP BY c.folder, cur""", MAIL_EVENTS, _CURSORS),
    "compensation_due": """SELECT c_name AS folder, CASE WHEN c_custkey % 25 >= 20 OR (c_custkey % 3 <> 0 AND c_custkey % 50 > 24) THEN 1 ELSE 0 END AS due
FROM customer""",
    "compensating_reread": """SELECT event_type AS folder, event_id AS uid FROM events
WHERE event_type IN ('click', 'view') AND event_id % 37 = 0 AND ts::DATE >= (SELECT max(ts)::DATE - 19 FROM events)""",
    "epoch_stale": with_ctes("""SELECT folder, count(*) FILTER (folder = 'error' OR id % 50 = 0) AS stale,
  count(*) FILTER (NOT (folder = 'error' OR id % 50 = 0)) AS live FROM mail_events GROUP BY 1""", MAIL_EVENTS),
    "moved_messages": with_ctes("""SELECT folder, count(*) FILTER (id % 40 = 0 OR (uid % 9 = 0 AND folder <> 'view')) AS moved
FROM mail_events GROUP BY 1""", MAIL_EVENTS),
    "arrival_actions": with_ctes("""SELECT folder, uid, CASE WHEN twin THEN 'copy' ELSE act END AS action,
  coalesce(known, reuse, dup, -1) AS match_id, CASE WHEN twin THEN fst[2] ELSE -1 END AS batch_of FROM decided""", MAIL_EVENTS, _ARRIVE),
    "reactivate_moved": with_ctes("""
, woken AS (SELECT reuse AS id, min((folder, uid)) AS w FROM decided WHERE act = 'reactivated' GROUP BY 1),
after AS (SELECT coalesce(w[1], folder) AS folder, extract_status, CASE WHEN w IS NULL AND stale THEN 1 ELSE 0 END AS stale,
    CASE WHEN is_canonical THEN 1 ELSE 0 END AS is_canonical, coalesce(w[2], uid) AS uid FROM stored LEFT JOIN woken USING (id)
  UNION ALL SELECT folder, CASE WHEN act = 'copy' OR twin THEN 'done' ELSE 'pending' END, 0, CASE WHEN act = 'copy' OR twin THEN 0 ELSE 1 END, uid
  FROM decided WHERE act IN ('copy', 'new'))
SELECT folder, extract_status, stale, is_canonical, count(*) AS n, sum(uid) AS uid_sum FROM after GROUP BY 1, 2, 3, 4""".strip(),
                                  MAIL_EVENTS, _ARRIVE).replace(")\n, woken AS", "),\nwoken AS"),
    "ingest_ledger": """SELECT event_id AS uid, CASE WHEN (event_id + s) % 4 = 0 THEN 'fetch_failed' ELSE 'synced' END AS status,
  CASE WHEN (event_id + s) % 4 = 0 THEN 'err' || s ELSE '' END AS error
FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS s FROM events)""",
    "claim_reclaim": with_ctes(f"""SELECT id, CASE WHEN s = 'pending' AND extract_attempts >= 4 THEN 'failed' ELSE s END AS extract_status
FROM (SELECT id, extract_attempts, CASE WHEN extract_status = 'running' AND fetched_at <= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE THEN 'pending'
  ELSE extract_status END AS s FROM mail_orders)""", MAIL_ORDERS),
    "claim_next": with_ctes("""SELECT id, 'running' AS extract_status FROM mail_orders WHERE account = 'a1' AND extract_status = 'pending'
AND is_canonical ORDER BY id LIMIT 200""", MAIL_ORDERS),
    "attempt_results": with_ctes("""SELECT id, CASE WHEN extract_status <> 'running' THEN extract_status WHEN id % 2 = 1 THEN 'done'
  WHEN extract_attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS extract_status,
  extract_attempts + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS extract_attempts FROM mail_orders""", MAIL_ORDERS),
    "contact_replies": """WITH t AS (SELECT conv_id, turn, role, role || (conv_id % 5) AS addr FROM conversations),
f AS (SELECT conv_id, addr, min(turn) AS first FROM t WHERE role <> 'assistant' GROUP BY 1, 2),
s AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY 1)
SELECT 'a' AS account, addr, count(*) AS replied_count FROM f JOIN s USING (conv_id) WHERE last > first GROUP BY 2""",
    "sync_rollup": with_ctes("""SELECT count(*) AS scanned, count(*) FILTER (is_canonical) AS inserted, count(*) FILTER (NOT is_canonical) AS duplicated,
  1 AS has_errors FROM mail_events""", MAIL_EVENTS),
    "run_errors": """SELECT string_agg('#' || event_id || ' failed', ';' ORDER BY event_id) AS errors, 2 AS exit_code
FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10)""",
}
