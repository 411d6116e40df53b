"""The registered queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOPICS = ("texts", "extraction", "mailbox", "reviewing", "ingesting", "reconciling", "conversations", "reporting",
          "filed", "parsing", "streams", "stateful")

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: fn for topic in _topics() for name, fn in topic.QUERIES.items()}


# whole-number columns that SQL would type narrower or wider than the queries do
LONGS = {
    "clean_body_hash": "truncated", "header_fields": "has_unsubscribe", "exact_copies_canonical": "is_canonical",
    "prefilter_verdicts": "extract call_llm", "rule_hits_iso": "all_day has_time vague ambiguous",
    "confidence_gate": "requires_review", "slot_dedupe": "all_day requires_review", "conflict_marks": "requires_review",
    "llm_response_normalise": "requires_review", "ics_gate": "requires_review",
    "sender_rollup": "replied_count has_unsubscribe", "mailbox_filters": "events", "mark_read_resolved": "already_seen",
    "auto_push_whitelist": "auto_pushable", "command_effects": "manual_edited needs_attention",
    "upsert_protected": "needs_attention", "orphan_removal": "removable",
    "incremental_cursor": "uid_validity syncs_since_full", "compensation_due": "due",
    "reactivate_moved": "stale is_canonical uid_sum", "attempt_results": "extract_attempts", "sync_rollup": "has_errors",
    "run_errors": "exit_code", "payload_hash_diff": "same", "removal_actions": "id_sum", "push_effects": "needs_attention",
    "failure_escalation": "needs_attention", "thread_rebuild": "is_ghost",
    "thread_stats": "orphaned_by_missing_id cycles_broken", "weak_subject_merge": "by_subject", "audit_suspicion": "level",
    "noise_components": "senders messages unread listed", "audit_report_lines": "n_lines", "calendar_listing": "all_day", "parse_messages": "has_unsubscribe",
    "parse_html_messages": "had_html", "parse_ics": "all_day cancelled", "stream_ingest": "uid_sum",
}


def all_oracles() -> dict[str, str]:
    return {name: _typed(name, sql) for topic in _topics() for name, sql in topic.ORACLES.items()}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LONGS.get(name, "").split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql.strip()})" if casts else sql


def _topics():
    return [importlib.import_module(f"mailspark.queries.{t}") for t in TOPICS]
