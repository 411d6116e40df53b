"""Declared schemas of the state tables, and checks of their value domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailspark import lexicon as lx

TABLES = {
    "messages": (
        "id long, account string, folder string, uid_validity long, uid long, normalized_message_id string, "
        "duplicate_of long, is_canonical boolean, thread_id long, in_reply_to string, references_ids array<string>, "
        "subject string, from_addr string, from_name string, to_addrs array<string>, sent_at timestamp, "
        "received_at timestamp, has_ics boolean, has_unsubscribe boolean, list_id string, auto_submitted string, "
        "body_excerpt string, body_sha256 string, body_purged boolean, flags array<string>, stale boolean, "
        "folder_moved boolean, moved_to_folder string, fetched_at timestamp, extract_status string, "
        "extract_attempts int, marked_read_at timestamp"),
    "events": (
        "id long, message_id long, thread_id long, title string, start_ts timestamp, end_ts timestamp, "
        "all_day boolean, tz string, location string, organizer string, source string, confidence double, "
        "fingerprint string, evidence string, status string, field_provenance map<string,string>, "
        "needs_attention boolean, gcal_event_id string, gcal_etag string, remote_norm_hash string, "
        "local_norm_hash string, snapshot_hash string, snapshot_payload string, managed_state string, "
        "last_checked_at timestamp, ics_uid string, ics_sequence int, ics_recurrence_id string, ics_rrule string, "
        "push_attempts int, manual_edited boolean, created_at timestamp, updated_at timestamp"),
    "threads": (
        "id long, account string, root_message_id string, subject_norm string, last_direction string, "
        "last_message_at timestamp, link_strength string, status string"),
    "scheduled_pushes": (
        "id long, event_id long, scheduled_for timestamp, state string, run_id string, created_at timestamp, "
        "dispatched_at timestamp, error string"),
    "processed_mail": (
        "account string, folder string, uid_validity long, uid long, status string, error string, "
        "processed_at timestamp"),
    "sync_state": (
        "account string, folder string, uid_validity long, highest_uid long, syncs_since_full int, "
        "last_sync_at timestamp, last_full_sync_at timestamp"),
    "senders": (
        "account string, addr string, name string, total long, unread long, replied_count long, "
        "last_seen_at timestamp, has_unsubscribe boolean, noise_score double"),
    "runs": (
        "id long, run_id string, command string, started_at timestamp, ended_at timestamp, stats_json string, "
        "ok boolean, error string, exit_code int"),
    "raw_messages": (
        "account string, folder string, uid_validity long, uid long, raw binary, flags array<string>, "
        "internal_date string, size long"),
    "remote_payloads": "event_id string, etag string, payload string",
    "commands": "seq long, action string, event_ids string, title string, start_ts timestamp",
    "llm_responses": "message_id long, response string",
    "unsubscribe_log": "id long, account string, addr string, target string, created_at timestamp",
    "todos": "id long, message_id long, title string, due_at timestamp, status string",
    "todo_reminders": "id long, todo_id long, remind_at timestamp",
    "app_meta": "key string, value string",
}

CANDIDATE = (
    "message_id long, ord int, title string, start_ts timestamp, end_ts timestamp, all_day boolean, source string, "
    "confidence double, fingerprint string, evidence string, location string, organizer string, tz string, "
    "ics_uid string, ics_sequence int, ics_recurrence_id string, ics_rrule string, requires_review boolean, "
    "review_reason string, title_from_subject boolean")

DOMAINS = {
    "events": {"status": lx.EVENT_STATUSES, "source": lx.EVENT_SOURCES},
    "messages": {"extract_status": lx.EXTRACT_STATUSES},
    "scheduled_pushes": {"state": lx.QUEUE_STATES},
    "processed_mail": {"status": ("synced", "fetch_failed")},
    "threads": {"link_strength": ("strong", "weak")},
}


def domain_violations(table: str, df: DataFrame) -> DataFrame:
    """Rows outside a table's value domains, one count per column: the CHECK constraints as a report."""
    checks = DOMAINS.get(table, {})
    counts = df.agg(*[F.count_if(~F.col(c).isin(*allowed)).alias(c) for c, allowed in checks.items()])
    return counts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in checks]), F.array(*[F.col(c) for c in checks]))).alias("column", "violations"))


def assert_domain(table: str, df: DataFrame) -> DataFrame:
    """The rows that satisfy a table's domains; a null is allowed, as in a CHECK."""
    for column, allowed in DOMAINS.get(table, {}).items():
        df = df.where(F.col(column).isNull() | F.col(column).isin(*allowed))
    return df
