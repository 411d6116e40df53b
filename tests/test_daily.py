"""The chain over versioned state tables, run twice: the second run must change nothing."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from mailspark.plans.daily import DailyRun, Failures, Settings
from mailspark.sources.reports import read_text
from tests.conftest import rows
from tests.corpus import SAMPLES


def test_daily_run_is_idempotent(spark, tmp_path):
    schema = "account string, folder string, uid_validity long, uid long, raw binary, flags array<string>, internal_date string"
    mails = [("me", "INBOX", 1, i + 1, bytearray(raw), [], "2026-09-14T02:00:00Z") for i, (_, raw) in enumerate(SAMPLES)]
    mails.append(("me", "Archive", 1, 1, bytearray(SAMPLES[1][1]), ["\\Seen"], "2026-09-14T02:00:00Z"))
    raw = spark.createDataFrame(mails, schema)
    folders = spark.createDataFrame([("me", "INBOX", 1, 99, 0), ("me", "Archive", 1, 99, 1)],
                                    "account string, folder string, uid_validity long, uid_next long, folder_ord int")
    remote = spark.createDataFrame([], "event_id string, etag string, payload string")
    root = str(tmp_path / "state")
    settings = Settings(own_addresses=["me@example.com"])
    first = DailyRun(spark, root, settings, datetime(2026, 9, 14, 2, 0))
    code = first.run(raw, folders, remote)
    log = rows(spark.read.parquet(f"{root}/runs"), "id")
    assert [(r["command"], r["error"]) for r in log] == [
        (c, None) for c in ("sync", "threads", "extract", "push", "mark_read", "digest")]
    assert code == 0
    messages = first.table("messages").read()
    # the archived copy was stored, but is no canonical row and needs no extraction
    assert messages.count() == len(SAMPLES) + 1
    assert messages.where("not is_canonical and extract_status = 'done' and duplicate_of is not null").count() == 1
    events = {(r["message_id"], r["fingerprint"]): r for r in rows(first.table("events").read())}
    assert len(events) == 12
    # no sender is a contact yet, so calendar entries wait as well: six rule hits are queued
    assert first.table("scheduled_pushes").read().where("state = 'queued'").count() == 6
    assert "pending" in {r["section"] for r in rows(spark.read.parquet(f"{root}/digest"))}

    second = DailyRun(spark, root, settings, datetime(2026, 9, 14, 2, 10))
    assert second.run(raw, folders, remote) == 0
    assert second.table("messages").read().count() == len(SAMPLES) + 1
    again = {(r["message_id"], r["fingerprint"]): r["id"] for r in rows(second.table("events").read())}
    assert again == {k: r["id"] for k, r in events.items()}
    assert second.table("scheduled_pushes").read().count() == 6
    assert second.table("messages").read().where("folder_moved").count() == 0  # no listing, so nothing has moved

    # a person approves what is queued: it does not wait any longer
    queued = rows(second.table("scheduled_pushes").read().where("state = 'queued'"), "event_id")
    commands = spark.createDataFrame([(1, str(queued[0]["event_id"]), "approve", None, None)],
                                     "seq long, event_ids string, action string, title string, start_ts timestamp")
    listing = raw.where("folder = 'INBOX' and uid > 1").select("account", "folder", "uid_validity", "uid")
    third = DailyRun(spark, root, settings, datetime(2026, 9, 14, 2, 20))
    assert third.run(raw, folders, remote, listing=listing, commands=commands) == 0
    states = {r["event_id"]: r["state"] for r in rows(third.table("scheduled_pushes").read())}
    status = {r["id"]: r["status"] for r in rows(third.table("events").read())}
    approved = queued[0]["event_id"]
    assert (states[approved] == "cancelled") == (status[approved] == "approved")
    gone = rows(third.table("messages").read().where("folder_moved").select("folder", "uid"))
    assert gone == [{"folder": "INBOX", "uid": 1}]
    # one report per date: the later one replaced the earlier
    assert spark.read.parquet(f"{root}/digest").select(F.col("digest_date").cast("string")).distinct().count() == 1


def test_audit_stage_files_its_report(spark, tmp_path):
    schema = "account string, folder string, uid_validity long, uid long, raw binary, flags array<string>, internal_date string"
    raw = spark.createDataFrame([("me", "INBOX", 1, i + 1, bytearray(raw), [], "2026-09-14T02:00:00Z")
                                 for i, (_, raw) in enumerate(SAMPLES)], schema)
    folders = spark.createDataFrame([("me", "INBOX", 1, 99, 0)],
                                    "account string, folder string, uid_validity long, uid_next long, folder_ord int")
    root = str(tmp_path / "state")
    run = DailyRun(spark, root, Settings(own_addresses=["me@example.com"], audit_hours=48), datetime(2026, 9, 14, 2, 0))
    assert run.run(raw, folders) == 0
    log = {r["command"]: json.loads(r["stats_json"]) for r in rows(spark.read.parquet(f"{root}/runs"))}
    assert log["audit"]["messages"] == spark.read.json(f"{root}/reports/audit_items").count() > 0
    for name, title in (("audit", "# 抽取复盘 · 2026-09-14"), ("digest", "# 邮件摘要 · 2026-09-14")):
        lines = rows(read_text(spark, f"{root}/reports/{name}"), "line_no")
        assert [r["line_no"] for r in lines] == list(range(1, len(lines) + 1))
        assert lines[0] == {"report_date": "2026-09-14", "line_no": 1, "line": title}
    assert f"邮件 {log['audit']['messages']} 封" in rows(read_text(spark, f"{root}/reports/audit"), "line_no")[3]["line"]


def test_failures_are_recorded_and_tried_again(spark, tmp_path):
    schema = "account string, folder string, uid_validity long, uid long, raw binary, flags array<string>, internal_date string"
    mails = [("me", "INBOX", 1, i + 1, bytearray(raw), [], "2026-09-14T02:00:00Z") for i, (_, raw) in enumerate(SAMPLES)]
    folders = spark.createDataFrame([("me", "INBOX", 1, 99, 0)],
                                    "account string, folder string, uid_validity long, uid_next long, folder_ord int")
    remote = spark.createDataFrame([], "event_id string, etag string, payload string")
    root, uids = str(tmp_path / "state"), "account string, folder string, uid_validity long, uid long, error string"
    plain = DailyRun(spark, str(tmp_path / "plain"), now=datetime(2026, 9, 14, 2, 0))
    assert plain.run(spark.createDataFrame(mails, schema), folders, remote) == 0
    per_message = {r["message_id"]: r["count"] for r in plain.table("events").read().groupBy("message_id").count().collect()}
    bad = min(per_message)

    lost = spark.createDataFrame([("me", "INBOX", 1, 90, "timed\nout"), ("me", "INBOX", 1, 1, "late")], uids)
    for attempt, minutes in enumerate((0, 10), 1):  # the message fails twice: the second time for good
        run = DailyRun(spark, root, Settings(extract_max_attempts=2), datetime(2026, 9, 14, 2, minutes))
        failures = Failures(fetch=lost, extract=spark.createDataFrame([(bad,), (10 ** 6,)], "id long"))
        assert run.run(spark.createDataFrame(mails, schema), folders, remote, failures=failures) == 0
        row = run.table("messages").read().where(F.col("id") == bad).first()
        assert (row["extract_status"], row["extract_attempts"]) == (("pending", 1), ("failed", 2))[attempt - 1]
    found = {r["message_id"]: r["count"] for r in run.table("events").read().groupBy("message_id").count().collect()}
    assert found == {m: n for m, n in per_message.items() if m != bad}
    states = {r["extract_status"] for r in run.table("messages").read().where(F.col("id") != bad).collect()}
    assert states == {r["extract_status"] for r in plain.table("messages").read().where(F.col("id") != bad).collect()}
    ledger = {r["uid"]: (r["status"], r["error"]) for r in run.table("processed_mail").read().collect()}
    assert ledger[90] == ("fetch_failed", "timed out") and ledger[2] == ("synced", None)

    # three failed attempts on one event and one on another
    one, two = sorted(r["id"] for r in run.table("events").read().collect())[:2]
    last = DailyRun(spark, root, Settings(push_max_attempts=3), datetime(2026, 9, 14, 2, 20))
    last.push(remote, spark.createDataFrame([(one,)] * 3 + [(two,)], "id long"))
    rows_ = {r["id"]: (r["status"], r["push_attempts"], r["needs_attention"]) for r in last.table("events").read().collect()}
    assert rows_[one] == ("push_failed", 3, True) and rows_[two] == ("push_failed", 1, False)
