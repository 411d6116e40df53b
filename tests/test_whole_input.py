"""Nothing is lost, doubled, cut or fatal: arrivals of a reset folder, repeated candidates, very long inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailspark.functions.headers import parse_unsubscribe
from mailspark.functions.text import clean_body
from mailspark.functions.titles import clean_fragment
from mailspark.operators import ingest, review, store
from mailspark.operators.rules import rule_hits
from mailspark.schema import TABLES
from mailspark.sources.ics import parse_ics
from tests.conftest import rows

def now():
    return F.lit("2026-09-14 02:00:00").cast("timestamp")



def _stored(spark, hashes):
    made = [{"id": k, "account": "me", "folder": "INBOX", "uid_validity": 1, "uid": k, "body_sha256": h,
             "normalized_message_id": m, "is_canonical": True, "stale": True, "folder_moved": False,
             "extract_status": "done", "extract_attempts": 0, "flags": []} for k, (h, m) in enumerate(hashes, 1)]
    return spark.createDataFrame(made, TABLES["messages"])


def _arrivals(spark, hashes):
    return spark.createDataFrame(
        [("me", "INBOX", 2, k, h, m, []) for k, (h, m) in enumerate(hashes, 1)],
        "account string, folder string, uid_validity long, uid long, body_sha256 string, normalized_message_id string, flags array<string>")


@pytest.mark.parametrize("stored, come, woken", [
    ([("h", "a"), ("h", "b")], [("h", "a"), ("h", "b"), ("h", "c")], 2),   # one body, three mails, two rows
    ([("h", "a"), ("x", "b")], [("h", "b"), ("y", "b")], 2),                # by hash first, then by id with what is left
    ([("h", "a")], [("q", "z"), ("h", "z")], 1),
    ([], [("h", "a"), ("h", "a")], 0),
])
def test_every_arrival_of_a_reset_folder_ends_in_one_row(spark, stored, come, woken):
    messages, arrivals = _stored(spark, stored), _arrivals(spark, come)
    decided = ingest.classify_arrivals(arrivals, messages)
    assert decided.count() == len(come) and decided.where("action = 'reactivated'").count() == woken
    taken = [r.match_id for r in decided.where("action = 'reactivated'").collect()]
    assert len(taken) == len(set(taken))
    after = ingest.apply_arrivals(messages, decided, now())
    held = rows(after.where("uid_validity = 2").select("uid"), "uid")
    assert [r["uid"] for r in held] == list(range(1, len(come) + 1))
    assert after.count() == len(stored) + len(come) - woken
    # the same batch again: everything is known
    numbered = store.number_new_rows(after)
    assert {r.action for r in ingest.classify_arrivals(arrivals, numbered).collect()} == {"known"}


def test_repeated_candidates_stay_one_row(spark):
    columns = ("message_id long, fingerprint string, title string, start_ts timestamp, source string, confidence double, "
               "evidence string, requires_review boolean, review_reason string")
    found = spark.createDataFrame([
        (1, "f", "first", datetime(2026, 9, 1), "ics", 0.9, "a", False, ""), (1, "f", "last", datetime(2026, 9, 2), "rules", 0.5, "b", False, ""),
        (1, "", "x", None, "ics", 0.9, "a", False, ""), (1, "", "y", None, "ics", 0.9, "a", False, "")], columns)
    events = spark.createDataFrame([], TABLES["events"])
    seen = []
    for _ in range(3):
        after = store.number_new_rows(store.upsert_candidates(events, found, now()).drop("outcome"))
        events = spark.createDataFrame(after.collect(), TABLES["events"])
        seen.append([(r["fingerprint"], r["title"], r["source"]) for r in rows(events, "fingerprint")])
    assert seen == [[("", "y", "ics"), ("f", "last", "ics")]] * 3


def test_long_forwarded_header_and_brackets(spark):
    text = "before\n-----\n" + "From: a\n" * 100_000 + "after"
    title = "[" + " " * 20_000
    row = spark.createDataFrame([(text, title)], "t string, s string").select(
        clean_body(F.col("t")).alias("b"), clean_fragment(F.col("s")).alias("s")).first()
    assert row.b == "before\nafter"


def test_text_of_many_dated_paragraphs(spark):
    body = "\n\n".join(f"Meeting on 2027-{1 + k % 12:02d}-{1 + k % 28:02d} at {k % 24:02d}:{k % 60:02d}" for k in range(30_000))
    mail = spark.createDataFrame([(1, "s", body, datetime(2026, 9, 1))], "message_id long, subject string, text string, received_at timestamp")
    hits = rule_hits(mail)
    assert hits.select("hit_ord").distinct().count() == hits.count() > 300
    assert hits.agg(F.max("hit_ord")).first()[0] > 1 << 32


def test_long_lines_are_kept_whole(spark):
    long = "x" * 1_200_000
    ics = f"BEGIN:VEVENT\nUID:1\nSUMMARY:{long}\nDTSTART:20260914T020000Z\nEND:VEVENT\n"
    assert parse_ics(spark.createDataFrame([(1, ics)], "message_id long, raw string")).select(F.length("summary")).first()[0] == len(long)
    mail = spark.createDataFrame([(f"<mailto:{long}@x>",)], "h string").select(parse_unsubscribe(F.col("h"))["mailto"].alias("m"))
    assert len(mail.first().m) == len(long) + 2


def test_a_range_of_any_length(spark):
    commands = spark.createDataFrame([(1, "7,3000000-1,9"), (2, "5-7,6,8")], "seq long, event_ids string")
    ids = review.expand_ids(commands)
    assert ids.where("seq = 1").count() == 3_000_000
    assert [(r.id, r.pos) for r in ids.where("seq = 2").orderBy("pos").collect()] == [(5, 0), (6, 1), (7, 2), (8, 4)]
    for wrong in ("-5", "1,x", "2--3"):
        with pytest.raises(Exception, match="cannot read event ids"):
            review.expand_ids(spark.createDataFrame([(1, wrong)], "seq long, event_ids string")).collect()
