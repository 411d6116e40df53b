"""Streams with state: equal to the batch form, one verdict for each uid, restarts, time."""

from datetime import datetime, timedelta
import random

from pyspark.sql import functions as F

from mailspark.operators import ingest as ig
from mailspark.streaming import jobs, stateful as sf
from tests.conftest import rows

KEY = ["account", "folder", "uid_validity", "uid"]
ARRIVAL = "account string, folder string, uid_validity long, uid long, body_sha256 string, normalized_message_id string, ord long, flags array<string>"
STORED = ("id long, account string, folder string, uid_validity long, uid long, body_sha256 string, normalized_message_id string, "
          "stale boolean, folder_moved boolean, moved_to_folder string, is_canonical boolean, duplicate_of long, flags array<string>, "
          "fetched_at timestamp, extract_status string, extract_attempts int, body_purged boolean")


class Feed:
    """A folder that files arrive in, and the stream over it."""

    def __init__(self, spark, path, kind):
        self.spark, self.path, self.kind = spark, str(path), kind

    def put(self, data):
        self.spark.createDataFrame(data, self.kind).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, stream):
        sf.run_to_end(stream, lambda s: jobs.to_batches(s, f"{self.path}/out", f"{self.path}/log"))
        return self.spark.read.schema(stream.schema).parquet(f"{self.path}/out").drop("batch_id")


def case(seed=3, n=80):
    """Stored rows and arrivals of few contents: sleeping rows, non-canonical rows, messages without body or id."""
    rng = random.Random(seed)
    content = lambda: rng.choice([(f"h{k}", f"m{k}") for k in range(8)] + [("", f"n{k}") for k in range(3)] + [("", ""), (None, None)])
    stored = []
    for k in range(n):
        h, m = content()
        stored.append((k, "a", rng.choice("xy"), 1, k, h, m, rng.random() < 0.2, rng.random() < 0.1, None, rng.random() < 0.6, None, [],
                       None, "done", 0, False))
    arrivals = []
    for k in range(n, 2 * n):
        h, m = content()
        arrivals.append(("a", rng.choice("xy"), 1, k, h, m, k, ["\\Seen"]))
    old = [("a", s[2], 1, s[4], s[5], s[6], 2 * n + s[0], ["\\Seen"]) for s in stored[::9]]
    return stored, arrivals + old


def test_arrivals_equal_the_batch_form(spark, tmp_path):
    stored, arrivals = case()
    messages = spark.createDataFrame(stored, STORED)
    feed = Feed(spark, tmp_path, ARRIVAL)
    feed.put(arrivals)
    verdicts = feed.run(sf.arrival_verdicts(feed.stream(), messages))
    batch = spark.createDataFrame(arrivals, ARRIVAL)
    mine = sf.decided(batch, verdicts).cache()
    theirs = ig.classify_arrivals(batch.withColumn("folder_ord", F.col("ord")), messages).cache()
    pick = lambda d: rows(d.select(*KEY, "action", "match_id", "batch_of"), *KEY)
    assert pick(mine) == pick(theirs)
    assert {r["action"] for r in pick(mine)} == {"known", "reactivated", "copy", "new"}
    now = F.lit("2026-01-01").cast("timestamp")
    after = [rows(ig.apply_arrivals(messages, d, now), *KEY, "stale") for d in (mine, theirs)]
    assert after[0] == after[1] and len(after[0]) > len(stored)


def test_arrivals_over_many_batches_and_restarts(spark, tmp_path):
    """File by file, in order, with repeats and a second run: the same verdicts, each told once."""
    stored, arrivals = case(5)
    messages = spark.createDataFrame(stored, STORED)
    feed = Feed(spark, tmp_path, ARRIVAL)
    for k in range(0, 60, 30):
        feed.put(arrivals[k:k + 30] + arrivals[:5])
        feed.run(sf.arrival_verdicts(feed.stream(), messages))
    once = feed.run(sf.arrival_verdicts(feed.stream(), messages)).collect()
    feed.put(arrivals[60:] + arrivals[10:40])
    got = feed.run(sf.arrival_verdicts(feed.stream(), messages))
    theirs = ig.classify_arrivals(spark.createDataFrame(arrivals, ARRIVAL).withColumn("folder_ord", F.col("ord")), messages)
    assert len(once) == 60 and got.count() == len(arrivals)
    assert rows(got.select(*KEY, "action", "match_id"), *KEY) == rows(theirs.select(*KEY, "action", "match_id"), *KEY)


def test_arrivals_without_stored_rows_and_without_arrivals(spark, tmp_path):
    empty = spark.createDataFrame([], STORED)
    feed = Feed(spark, tmp_path / "a", ARRIVAL)
    feed.put([("a", "x", 1, 1, "h", "m", 1, []), ("b", "x", 1, 1, "h", "m", 1, []), ("a", "x", 1, 2, "h", "m", 2, [])])
    got = feed.run(sf.arrival_verdicts(feed.stream(), empty))
    assert [(r["account"], r["uid"], r["action"], r["leader_uid"]) for r in rows(got, "account", "uid")] == [
        ("a", 1, "new", None), ("a", 2, "copy", 1), ("b", 1, "new", None)]


def test_release(spark, tmp_path):
    start = datetime(2026, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    feed = Feed(spark, tmp_path, "queue_id long, op string, at timestamp, ts timestamp")
    feed.put([(1, "queue", at(30), at(0)), (2, "queue", at(30), at(0)), (2, "cancel", at(10), at(10)), (3, "queue", at(500), at(1)),
              (4, "queue", at(20), at(2)), (4, "queue", at(25), at(3)), (5, "cancel", at(4), at(4))])
    run = lambda: rows(feed.run(sf.timed_release(feed.stream())), "queue_id")
    assert [(r["queue_id"], r["state"], r["at"]) for r in run()] == [(2, "cancelled", at(10))]
    assert {r["queue_id"] for r in sf.still_queued(spark, f"{feed.path}/log").collect()} == {1, 3, 4}
    # time moves on: 1 and 4 leave; a cancel after the release, and a repeat, change nothing
    feed.put([(9, "queue", at(900), at(40))])
    assert [(r["queue_id"], r["state"], r["at"]) for r in run()] == [
        (1, "dispatched", at(30)), (2, "cancelled", at(10)), (4, "dispatched", at(20))]
    feed.put([(1, "cancel", at(45), at(45)), (2, "queue", at(60), at(46)), (4, "queue", at(70), at(47)), (3, "cancel", at(48), at(48)),
              (8, "queue", at(2000), at(1000))])
    assert [(r["queue_id"], r["state"]) for r in run()] == [
        (1, "dispatched"), (2, "cancelled"), (3, "cancelled"), (4, "dispatched"), (9, "dispatched")]
    assert rows(sf.still_queued(spark, f"{feed.path}/log")) == [{"queue_id": 8, "at": at(2000)}]


def test_release_waits_for_late_cancels(spark, tmp_path):
    """With lateness an item stays withdrawable until event time has surely passed it."""
    start = datetime(2026, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    feed = Feed(spark, tmp_path, "queue_id long, op string, at timestamp, ts timestamp")
    run = lambda: [(r["queue_id"], r["state"]) for r in rows(feed.run(sf.timed_release(feed.stream(), "1 hour")), "queue_id")]
    feed.put([(1, "queue", at(30), at(0)), (2, "queue", at(10), at(40))])
    assert run() == []
    feed.put([(1, "cancel", at(20), at(20))])
    assert run() == [(1, "cancelled")]
    feed.put([(7, "cancel", at(200), at(200))])
    assert run() == [(1, "cancelled"), (2, "dispatched")]


def test_release_forgets_after_the_time_to_remember(spark, tmp_path, monkeypatch):
    """Items of one bucket side by side: an ended item is remembered for an hour, not longer; then it may start anew."""
    monkeypatch.setattr(sf, "BUCKETS", 1, raising=False)
    start = datetime(2026, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    feed = Feed(spark, tmp_path, "queue_id long, op string, at timestamp, ts timestamp")
    run = lambda: [(r["queue_id"], r["state"], r["at"]) for r in rows(feed.run(sf.timed_release(feed.stream(), remember_hours=1)), "at")]
    feed.put([(1, "queue", at(10), at(0)), (2, "queue", at(9), at(0)), (2, "cancel", at(5), at(5)), (3, "cancel", at(6), at(6)),
              (None, "queue", at(11), at(7)), (4, None, None, at(8)), (5, "queue", at(900), at(20))])
    first = [(2, "cancelled", at(5)), (1, "dispatched", at(10)), (None, "dispatched", at(11))]
    assert run() == first
    feed.put([(1, "queue", at(40), at(30)), (2, "queue", at(40), at(31)), (7, "queue", at(2000), at(60))])
    assert run() == first  # both still remembered
    feed.put([(8, "queue", at(2000), at(200))])
    assert run() == first
    feed.put([(1, "queue", at(230), at(220)), (2, "queue", at(231), at(220)), (3, "queue", at(232), at(220)), (9, "queue", at(2000), at(300))])
    assert run() == first + [(1, "dispatched", at(230)), (2, "dispatched", at(231)), (3, "dispatched", at(232))]
    assert {r["queue_id"] for r in rows(sf.still_queued(spark, f"{feed.path}/log"))} == {5, 7, 8, 9}


def test_release_keeps_items_by_bucket(spark, tmp_path, monkeypatch):
    """A thousand items are few states, not a thousand."""
    monkeypatch.setattr(sf, "BUCKETS", 8, raising=False)
    start = datetime(2026, 1, 1)
    feed = Feed(spark, tmp_path, "queue_id long, op string, at timestamp, ts timestamp")
    feed.put([(k, "queue", start + timedelta(minutes=k + 5000), start) for k in range(1000)])
    feed.run(sf.timed_release(feed.stream()))
    state = spark.read.format("statestore").option("path", f"{feed.path}/log").option("stateVarName", "item").load()
    assert state.count() == 1000 and state.select("key").distinct().count() == 8
    assert rows(sf.still_queued(spark, f"{feed.path}/log"), "queue_id") == [
        {"queue_id": k, "at": start + timedelta(minutes=k + 5000)} for k in range(1000)]


def test_audit_counts_a_late_fetch_once_in_its_window(spark, tmp_path):
    day = lambda d, h=0: datetime(2026, 1, d, h)
    feed = Feed(spark, tmp_path, "id long, received_at timestamp, fetched_at timestamp, bad boolean")
    feed.put([(1, day(1, 1), day(1, 2), False), (2, day(1, 3), day(4, 3), True), (3, day(1, 4), None, False), (1, day(1, 1), day(1, 2), False)])
    feed.put([(8, day(20), day(20), False), (9, day(30), day(30), False)])
    got = rows(feed.run(sf.audit_two_axes(feed.stream(), "1 day", "1 day", bad=F.col("bad"))), "window_end")
    assert [(r["window_end"], r["n"], r["bad"]) for r in got] == [(day(2), 3, 1), (day(5), 1, 1), (day(21), 1, 0)]


def test_sessions_and_followers(spark, tmp_path):
    minute = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    feed = Feed(spark, tmp_path / "s", "user_id long, ts timestamp")
    feed.put([(1, minute(0)), (1, minute(20)), (1, minute(50)), (2, minute(5))])
    feed.put([(1, minute(70)), (3, minute(500))])
    got = rows(feed.run(sf.sessions(feed.stream(), ["user_id"], gap="30 minutes")), "user_id", "start")
    assert [(r["user_id"], r["start"], r["last"], r["n"]) for r in got] == [(1, minute(0), minute(70), 4), (2, minute(5), minute(5), 1)]
    pair = Feed(spark, tmp_path / "f", "queue_id long, op string, ts timestamp")
    pair.put([(1, "q", minute(0)), (2, "q", minute(0)), (1, "c", minute(90)), (2, "c", minute(91)), (1, "c", minute(3))])
    pair.put([(5, "q", minute(900)), (5, "c", minute(900))])
    stream = pair.stream()
    got = rows(pair.run(sf.followed(stream.where("op = 'q'"), stream.where("op = 'c'"), "queue_id", 90)).where("queue_id < 5"), "queue_id", "then_ts")
    assert [(r["queue_id"], r["then_ts"]) for r in got] == [(1, minute(3)), (1, minute(90)), (2, None)]


