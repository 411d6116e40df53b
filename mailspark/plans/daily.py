"""One run over all state tables: sync, extract, push, mark as read, digest.

Stages fail independently: a later stage still runs on the last committed version of its tables, every stage
leaves one row in the run log, and the worst exit code stands for the run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.functions.text import sanitize_error
from mailspark.operators import audit, candidates, digest, ingest, readstate, reconcile, review, stats, store, threads
from mailspark.operators.rules import DEFAULT_ZONE
from mailspark.session import checkpointed, pin_utc
from mailspark.sources import reports, sinks
from mailspark.sources.ics import parse_ics
from mailspark.sources.raw import parse_messages


@dataclass
class Settings:
    """What a run needs to know; the defaults are those of the interactive tool."""

    account: str = "me"
    own_addresses: list[str] = field(default_factory=list)
    tz: str = DEFAULT_ZONE
    sync_budget: int | None = None
    push_limit: int | None = None
    push_delay_minutes: int = 30
    push_max_attempts: int = 3
    extract_max_attempts: int = 3
    not_found_policy: str = "pending"
    mark_read_policy: str = "off"
    confidence_threshold: float = lx.AUTO_PUSH_THRESHOLD
    ambiguous_policy: str = "pending"
    max_chars: int | None = None
    #: Hours that the audit looks back; None leaves the stage out.
    audit_hours: int | None = None


@dataclass
class Failures:
    """What the clients outside could not do since the last run; a missing frame means that nothing failed.

    ``fetch``: account, folder, uid_validity, uid, error. ``extract``: id of a message, which stays out of this run's
    extraction. ``push``: id of an event, one row for each failed attempt.
    """

    fetch: DataFrame | None = None
    extract: DataFrame | None = None
    push: DataFrame | None = None


class DailyRun:
    """The chain over one root folder that holds a versioned table per state table."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None,
                 now: datetime | None = None) -> None:
        self.spark, self.root, self.settings = pin_utc(spark), root.rstrip("/"), settings or Settings()
        self.now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        self.run_id = uuid.uuid4().hex
        self._extracted: DataFrame | None = None  # figures of this run's extraction, for the digest

    def table(self, name: str) -> sinks.VersionedTable:
        return sinks.VersionedTable(self.spark, f"{self.root}/{name}", name)

    @property
    def _now(self):
        return F.lit(self.now).cast("timestamp")

    def run(self, raw: DataFrame, folders: DataFrame, remote: DataFrame | None = None,
            llm_responses: DataFrame | None = None, listing: DataFrame | None = None,
            commands: DataFrame | None = None, failures: Failures | None = None) -> int:
        """Run every stage; returns the worst exit code. ``listing`` is read by the sync stage, ``commands`` (seq,
        event_ids, action, title, start_ts) by the review stage; without commands there is no such stage. ``failures``
        are recorded by the stages that they belong to."""
        failed = failures or Failures()
        stages: list[tuple[str, Callable[[], dict]]] = [
            ("sync", lambda: self.sync(raw, folders, listing, failed.fetch)), ("threads", self.rebuild_threads),
            ("extract", lambda: self.extract(raw, llm_responses, failed.extract)),
            *([("review", lambda: self.review(commands))] if commands is not None else []),
            ("push", lambda: self.push(remote, failed.push) if remote is not None else {}),
            ("mark_read", self.mark_read), *([("audit", self.audit)] if self.settings.audit_hours else []), ("digest", lambda: self.digest(remote))]
        return max(self._stage(i, name, job) for i, (name, job) in enumerate(stages))

    def _stage(self, position: int, name: str, job: Callable[[], dict]) -> int:
        started, error, figures = datetime.now(timezone.utc).replace(tzinfo=None), None, {}
        try:
            figures = job()
        except Exception as problem:  # noqa: BLE001 - the next stages still run
            error = self.spark.range(1).select(sanitize_error(F.lit(str(problem)), None).alias("e")).first()["e"]
        code = 2 if error else 0
        sinks.append_run(self.spark, f"{self.root}/runs", {
            "id": int(self.now.timestamp()) * 10 + position, "run_id": self.run_id, "command": name, "started_at": started,
            "ended_at": datetime.now(timezone.utc).replace(tzinfo=None), "stats_json": json.dumps(figures),
            "ok": error is None, "error": error, "exit_code": code})
        return code

    def sync(self, raw: DataFrame, folders: DataFrame, listing: DataFrame | None = None,
             failed: DataFrame | None = None) -> dict:
        """raw: account, folder, uid_validity, uid, raw, flags, internal_date. folders: live state with folder_ord.

        listing: account, folder, uid_validity, uid of everything that the listed folders hold now. Only such a full
        listing tells what has moved away; without it nothing is marked. ``failed`` uids stand in the ledger with their
        error until a later run takes them; what failed and was taken in the same run was taken.
        """
        state, messages = self.table("sync_state"), self.table("messages")
        cursors = checkpointed(ingest.folder_cursor(folders, state.read()))
        taken = ingest.new_uids(raw, cursors, self.settings.sync_budget)
        parsed = checkpointed(parse_messages(taken, self.settings.max_chars).withColumn(
            "received_at", F.try_to_timestamp("internal_date")))
        stored = ingest.mark_stale(messages.read(), cursors)
        if listing is not None:
            stored = checkpointed(ingest.mark_moved(stored, listing))
        decided = checkpointed(ingest.classify_arrivals(parsed, stored))
        after = ingest.apply_arrivals(stored, decided, self._now)
        numbered = checkpointed(store.number_new_rows(after))
        messages.write(ingest.link_copies(numbered, decided))
        log = decided.select(*ingest.UID_KEY, F.lit("synced").alias("status"), F.lit(None).cast("string").alias("error"),
                             self._now.alias("processed_at"))
        if failed is not None:
            missed = failed.join(log, ingest.UID_KEY, "left_anti").select(
                *ingest.UID_KEY, F.lit("fetch_failed").alias("status"), sanitize_error(F.col("error"), None).alias("error"),
                self._now.alias("processed_at"))
            log = checkpointed(log.unionByName(missed))
        self.table("processed_mail").write(ingest.ledger(self.table("processed_mail").read(), log))
        fresh = decided.where("action <> 'known'")
        self.table("senders").write(ingest.merge_senders(self.table("senders").read(), ingest.sender_rollup(fresh)))
        # the cursor moves last: if anything above fails, the same uids are taken again and nothing doubles
        state.write(ingest.advance(state.read(), cursors, parsed, self._now))
        return {r["action"]: r["n"] for r in decided.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}

    def rebuild_threads(self) -> dict:
        messages = self.table("messages")
        rows = messages.read()
        made, members = threads.rebuild(rows, self.settings.own_addresses, self.settings.account)
        made, members = checkpointed(made), checkpointed(members.select("id", "thread_id"))
        messages.write(rows.drop("thread_id").join(members, "id", "left"))
        self.table("threads").write(made)
        return {"threads": made.count()}

    def extract(self, raw: DataFrame | None = None, llm_responses: DataFrame | None = None,
                failed: DataFrame | None = None) -> dict:
        """Claim pending messages, extract, store candidates, drop what is no longer found.

        ``failed`` (id) of the claimed messages count an attempt and wait again, or fail for good once their attempts
        are used; what is stored of them stays as it is.
        """
        most = self.settings.extract_max_attempts
        messages, events, pushes = self.table("messages"), self.table("events"), self.table("scheduled_pushes")
        rows = ingest.reclaim(messages.read(), self._now, max_attempts=most)
        due = checkpointed(rows.where("extract_status = 'pending' and is_canonical"))
        claimed = due.select("id", F.lit(True).alias("_claimed"))
        failed = claimed.select("id").join(failed, "id", "left_semi") if failed is not None else claimed.select("id").limit(0)
        due = checkpointed(due.join(failed, "id", "left_anti"))
        source = due.select(
            F.col("id").alias("message_id"), "subject", F.col("body_excerpt").alias("text"),
            F.coalesce("received_at", self._now).alias("received_at"), "auto_submitted",
            (F.col("list_id").isNotNull() | F.col("has_unsubscribe")).alias("is_list"), "has_ics", "from_addr")
        vevents = None
        if raw is not None:
            owners = due.where("has_ics").select(*ingest.UID_KEY, F.col("id").alias("message_id"))
            parts = parse_messages(raw.join(owners, ingest.UID_KEY), self.settings.max_chars).select(
                "message_id", F.explode("ics_parts").alias("p")).select("message_id", "p.raw")
            vevents = parse_ics(parts, self.settings.tz)
        else:
            # without the raw bytes there is no calendar part to read: the text path has to serve
            source = source.withColumn("has_ics", F.lit(False))
        contacts = ingest.replied_counts(rows, self.settings.own_addresses) if self.settings.own_addresses else (
            self.table("senders").read().where("replied_count > 0"))
        verdicts, found = candidates.extract(
            source, self._now, vevents, llm_responses, contacts.select("addr"), self.settings.tz,
            threshold=self.settings.confidence_threshold, ambiguous_policy=self.settings.ambiguous_policy)
        found = checkpointed(found)
        known, queue = events.read(), pushes.read()
        merged = checkpointed(store.number_new_rows(store.upsert_candidates(known, found, self._now)))
        lost = checkpointed(store.orphans(merged.drop("outcome"), found, queue, due.select(F.col("id").alias("message_id")),
                                          llm_usable=llm_responses is not None))
        left, queue = store.remove_orphans(merged.drop("outcome"), queue, lost)
        events.write(store.supersede(left))
        pushes.write(store.number_new_rows(queue.unionByName(review.schedule(
            events.read(), queue, self._now, self.settings.push_delay_minutes, self.settings.confidence_threshold))))
        before = checkpointed(messages.read().select("id", "extract_status", "extract_attempts"))
        was = F.col("extract_status")
        running = rows.join(claimed, "id", "left").withColumns({
            "_was": was, "extract_status": F.when(F.col("_claimed"), "running").otherwise(was)})
        after = checkpointed(ingest.after_attempt(running, failed, most).withColumn("extract_status", F.when(
            F.col("_claimed"), was).otherwise(F.col("_was"))).drop("_claimed", "_was"))
        messages.write(after)
        answered = llm_responses.select("message_id", F.col("response").isNotNull().alias("ok")) if (
            llm_responses is not None and "response" in llm_responses.columns) else None
        self._extracted = checkpointed(stats.extract_stats(verdicts, found, merged, lost, before, after, answered))
        return {f"{r['section']}/{r['key']}": r["n"] for r in self._extracted.collect()}

    def review(self, commands: DataFrame) -> dict:
        """Carry out a person's commands; an approval withdraws what was queued for its event."""
        events, pushes = self.table("events"), self.table("scheduled_pushes")
        changed, outcomes = review.transition(events.read(), review.expand_ids(commands), self._now)
        changed, outcomes = checkpointed(changed), checkpointed(outcomes)
        events.write(changed)
        pushes.write(review.withdraw_approved(pushes.read(), outcomes))
        return {r["result"]: r["n"] for r in outcomes.groupBy("result").agg(F.count(F.lit(1)).alias("n")).collect()}

    def push(self, remote: DataFrame, failed: DataFrame | None = None) -> dict:
        """Compare approved events with their copies, write the outbox, and record what was found.

        ``failed`` (id) are attempts on the last outbox that did not succeed: they count up, and at the limit the event
        asks for attention.
        """
        events, pushes = self.table("events"), self.table("scheduled_pushes")
        if failed is not None:
            events.write(reconcile.record_failures(events.read(), failed, self.settings.push_max_attempts, self._now))
        pushes.write(review.dispatch(pushes.read(), events.read(), self._now))
        plan = checkpointed(reconcile.push_plan(events.read(), remote, self.settings.push_limit,
                                                self.settings.not_found_policy, self.settings.tz))
        outbox = plan.where("action in ('create', 'update')").select("id", "action", "local_payload")
        sinks.write_json(outbox, f"{self.root}/outbox/run={self.run_id}")
        events.write(reconcile.apply_plan(events.read(), plan, self._now))
        return {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}

    def mark_read(self) -> dict:
        """The selection only: setting the flag is the mail server's business."""
        chosen = readstate.select_candidates(self.table("messages").read(), self.table("events").read(),
                                             self.settings.mark_read_policy)
        sinks.write_json(chosen, f"{self.root}/mark_read/run={self.run_id}")
        return {"policy": self.settings.mark_read_policy}

    def audit(self) -> dict:
        """A second look at the messages of the last hours: a Markdown report for its date, and its items as JSON."""
        hours = self.settings.audit_hours
        mail = self.table("messages").read()
        window = audit.window_messages(mail, self._now, hours, limit=None).withColumn(
            "is_list", F.col("list_id").isNotNull() | F.col("has_unsubscribe"))
        items = checkpointed(audit.audit_items(window, self.table("events").read(), self._now, tz=self.settings.tz))
        reports.write_text(audit.audit_document(items, self._now, hours, self.settings.tz), f"{self.root}/reports/audit")
        sinks.write_json(items, f"{self.root}/reports/audit_items/run={self.run_id}")
        return audit.audit_counts(items).first().asDict()

    def digest(self, remote: DataFrame | None = None) -> dict:
        read = {n: self.table(n).read() for n in ("messages", "processed_mail", "events", "scheduled_pushes", "threads",
                                                  "senders")}
        runs = self.spark.read.schema(self.table("runs").read().schema).parquet(f"{self.root}/runs")
        figures = stats.snapshot(read["messages"], read["processed_mail"], read["events"], read["scheduled_pushes"],
                                 read["threads"], read["senders"], runs)
        if self._extracted is not None:
            figures = figures.unionByName(self._extracted.where("section = 'extract'"))
        window = review.push_window(read["scheduled_pushes"], read["events"], self._now, 120)
        longest = threads.longest_threads(read["threads"], read["messages"])
        entries = digest.calendar_entries(remote, self.settings.tz) if remote is not None else None
        lines = checkpointed(digest.digest_lines(self._now, figures, read["events"], window, read["messages"], longest,
                                                 entries, self.settings.tz))
        sinks.write_report(lines, f"{self.root}/digest")
        reports.write_text(digest.digest_document(lines, self._now, read["events"], self.settings.tz),
                           f"{self.root}/reports/digest")
        return {"digest": "written"}
