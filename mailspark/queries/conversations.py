"""Thread queries: rebuild by pointer doubling, thread table, statistics, weak merge by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.functions.common import flag, iso_utc
from mailspark.operators import threads as th
from mailspark.queries.views import MAIL_TURNS, mail_turns, with_ctes


def thread_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    assigned = th.assign_threads(mail_turns(spark, folder))
    return assigned.select("id", "root_key", "strength", flag(F.col("is_ghost")).alias("is_ghost"))


def thread_table(spark: SparkSession, folder: str) -> DataFrame:
    threads, _ = th.rebuild(mail_turns(spark, folder), ["assistant"], "a")
    return threads.select("id", "root_message_id", "subject_norm", "last_direction",
                          iso_utc(F.col("last_message_at")).alias("last_message_at"), "link_strength", "status", "n")


def thread_longest(spark: SparkSession, folder: str) -> DataFrame:
    threads, members = th.rebuild(mail_turns(spark, folder))
    return th.longest_threads(threads, members).select("id", "root_message_id", "n")


def thread_stats(spark: SparkSession, folder: str) -> DataFrame:
    return th.thread_stats(th.assign_threads(mail_turns(spark, folder)))


def weak_subject_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All turns without their links: only equal subjects can bring them together."""
    roots = mail_turns(spark, folder).withColumns({
        "in_reply_to": F.lit(None).cast("string"), "references_ids": F.expr("cast(array() as array<string>)"),
        "subject": F.when(F.col("id") % 4000 == 0, F.lit("Reminder")).otherwise(F.col("subject")),
        "normalized_message_id": F.when(F.col("id") % 3000 != 0, F.col("normalized_message_id"))})
    assigned = th.assign_threads(roots)
    return assigned.select("id", "root_key", "strength", flag(F.col("by_subject")).alias("by_subject"))


QUERIES = {"thread_rebuild": thread_rebuild, "thread_table": thread_table, "thread_longest": thread_longest,
           "thread_stats": thread_stats, "weak_subject_merge": weak_subject_merge}

_WALK = """walk AS (
  SELECT id, conv_id, turn, CASE WHEN irt LIKE 'gone%' THEN irt ELSE mid END AS root_key FROM mail_turns WHERE turn = 0 OR irt LIKE 'gone%'
  UNION ALL SELECT t.id, t.conv_id, t.turn, w.root_key FROM mail_turns t JOIN walk w ON t.conv_id = w.conv_id AND t.turn = w.turn + 1
  WHERE t.turn > 0 AND (t.irt IS NULL OR t.irt NOT LIKE 'gone%')),
sized AS (SELECT root_key, count(*) AS n FROM walk GROUP BY 1),
lonely AS (SELECT w.root_key, subject_norm, received_at, id FROM walk w JOIN sized USING (root_key) JOIN mail_turns t USING (id)
  WHERE n = 1 AND root_key NOT LIKE 'gone%' AND irt IS NULL AND t.turn = 0),
keep AS (SELECT root_key, first_value(root_key) OVER (PARTITION BY subject_norm ORDER BY received_at, id) AS keeper,
  count(*) OVER (PARTITION BY subject_norm) AS m FROM lonely),
placed AS (SELECT w.id, coalesce(CASE WHEN m > 1 THEN keeper END, w.root_key) AS root_key, CASE WHEN m > 1 THEN 'weak' ELSE 'strong' END AS strength,
  w.root_key LIKE 'gone%' AS ghost, coalesce(m > 1 AND keeper <> w.root_key, false) AS by_subject, t.subject_norm, t.received_at, t.from_addr
  FROM walk w JOIN mail_turns t USING (id) LEFT JOIN keep k ON k.root_key = w.root_key),
tab AS (SELECT arg_min(id, (received_at, id)) AS id, root_key AS root_message_id, arg_min(subject_norm, (received_at, id)) AS subject_norm,
  CASE WHEN arg_max(from_addr, (received_at, id)) = 'assistant' THEN 'out' ELSE 'in' END AS last_direction,
  strftime(max(received_at), '%Y-%m-%dT%H:%M:%SZ') AS last_message_at, max(strength) AS link_strength,
  CASE WHEN bool_or(ghost) THEN 'ghost' ELSE 'active' END AS status, count(*) AS n FROM placed GROUP BY 2)"""


def _with(sql: str) -> str:
    return with_ctes(sql, MAIL_TURNS, _WALK).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "thread_rebuild": _with("SELECT id, root_key, strength, CASE WHEN ghost THEN 1 ELSE 0 END AS is_ghost FROM placed"),
    "thread_table": _with("SELECT * FROM tab"),
    "thread_longest": _with("SELECT id, root_message_id, n FROM tab WHERE n > 1 ORDER BY n DESC, last_message_at DESC, id LIMIT 10"),
    "thread_stats": _with("""SELECT (SELECT count(*) FROM placed) AS messages, count(*) AS threads, count(*) FILTER (link_strength = 'strong') AS strong,
  count(*) FILTER (link_strength = 'weak') AS weak, count(*) FILTER (status = 'ghost') AS ghosts, 0 AS orphaned_by_missing_id, 0 AS cycles_broken,
  (SELECT count(*) FROM placed WHERE by_subject) AS merged_by_subject FROM tab"""),
    "weak_subject_merge": """
WITH i AS (SELECT *, conv_id * 1000 + turn AS id FROM conversations),
r AS (SELECT id, CASE WHEN id % 3000 = 0 THEN 'sha256:' || substr(sha256(text), 1, 16) ELSE 'c' || conv_id || '.' || turn || '@x' END AS key,
    CASE WHEN id % 4000 = 0 THEN 'reminder' ELSE 'topic ' || (conv_id % 7) END AS s, (conv_id % 300, turn) AS d FROM i),
z AS (SELECT *, count(*) OVER (PARTITION BY key) AS same FROM r),
k AS (SELECT *, first_value(key) OVER (PARTITION BY s ORDER BY d, id) AS keeper, count(*) OVER (PARTITION BY s) AS m FROM z WHERE s <> 'reminder' AND same = 1)
SELECT z.id, CASE WHEN k.m > 1 THEN k.keeper ELSE z.key END AS root_key, CASE WHEN k.m > 1 THEN 'weak' ELSE 'strong' END AS strength,
  CASE WHEN k.m > 1 AND k.keeper <> z.key THEN 1 ELSE 0 END AS by_subject FROM z LEFT JOIN k USING (id)""",
}
