"""Streams that keep state: arrivals decided against what is known, timed release, audit on two time axes, sessions, joins.

Keyed state lives in RocksDB beside the checkpoint, so a micro-batch costs as much as its own rows, whatever is stored
(in timed_release: as its own rows and the items that are held in their buckets).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from mailspark.operators.ingest import UID_KEY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; a running stream is not touched."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_to_end(stream: DataFrame, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a stateful stream over all that has arrived, as a job does that is called again later."""
    with rocksdb(stream.sparkSession):
        query = start(stream)
    query.awaitTermination()


# --- arrivals --------------------------------------------------------------------------------------------------

CONTENT = ["account", "content"]
VERDICT = ("account string, content string, folder string, uid_validity long, uid long, action string, match_id long, "
           "leader_folder string, leader_validity long, leader_uid long")


def content_key() -> Column:
    """The body hash, else the message id, else the uid itself: a message without either is like no other."""
    filled = lambda c: F.when(F.length(c) > 0, F.concat(F.lit(c[0]), F.col(c)))
    return F.coalesce(filled("body_sha256"), filled("normalized_message_id"),
                      F.concat_ws("\x1f", F.lit("u"), "folder", F.col("uid_validity").cast("string"), F.col("uid").cast("string")))


class _Arrivals(StatefulProcessor):
    """State of one content: the uids that hold it, the first canonical one, and its sleeping rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.uids = handle.getMapState("uids", "folder string, uid_validity long, uid long", "id long, told boolean")
        self.first = handle.getValueState("first", "id long, folder string, uid_validity long, uid long")
        self.asleep = handle.getListState("asleep", "folder string, id long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState.sort_values("id")
        for r in rows.itertuples():
            self.uids.updateValue((r.folder, int(r.uid_validity), int(r.uid)), (int(r.id), False))
        canonical = rows[rows.is_canonical]
        if len(canonical):
            r = canonical.iloc[0]
            self.first.update((int(r.id), r.folder, int(r.uid_validity), int(r.uid)))
        if rows.asleep.any():
            self.asleep.put([(r.folder, int(r.id)) for r in rows[rows.asleep].itertuples()])

    def handleInputRows(self, key, rows, timerValues):
        """Arrivals of one content in one micro-batch, in their order; each uid is told its verdict once."""
        batch = pd.concat(list(rows)).sort_values(["ord", "folder", "uid", "uid_validity"])
        asleep = [tuple(r) for r in self.asleep.get()] if self.asleep.exists() else []
        waiting = sorted(asleep, key=lambda r: r[1])
        first = self.first.get() if self.first.exists() else None
        out = []
        for r in batch.itertuples():
            uid = (r.folder, int(r.uid_validity), int(r.uid))
            held = self.uids.getValue(uid) if self.uids.containsKey(uid) else None
            if held is not None and held[1]:
                continue
            leader = (None, None, None)
            if held is not None:
                action, match = "known", held[0]
            elif row := next((w for w in waiting if w[0] == r.folder), None):
                waiting.remove(row)
                action, match = "reactivated", row[1]
            elif first is not None:
                action, match = "copy", first[0]
                leader = tuple(first[1:]) if first[0] is None else leader
            else:
                action, match, first = "new", None, (None, *uid)
                self.first.update(first)
            self.uids.updateValue(uid, (match if action != "copy" else None, True))
            out.append((*key, *uid, action, match, *leader))
        if len(waiting) < len(asleep):
            self.asleep.put(waiting) if waiting else self.asleep.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")]).astype(
            {c: "Int64" for c in ("uid_validity", "uid", "match_id", "leader_validity", "leader_uid")})

    def close(self) -> None:
        pass


def arrival_verdicts(arrivals: DataFrame, messages: DataFrame) -> DataFrame:
    """Stream of verdicts: known, reactivated, copy or new for every uid, once, as it first arrives.

    arrivals: a stream of UID_KEY, body_sha256, normalized_message_id and ord (the order of arrival). messages: the rows
    stored when the stream first starts, with id, stale, folder_moved and is_canonical. They become the stream's first
    state and are not read again. Two messages are the same if their content_key() is: unlike the batch form, equal
    message ids with different bodies are different messages here.

    Verdicts follow ingest.classify_arrivals: a uid that is held is known; else the lowest sleeping row of its folder
    comes back; else the message is a copy of the first canonical one (match_id: its row, or leader_*: the arrival it
    came with), or new. A uid that comes again, also in a batch that runs again, says nothing.
    """
    thin = arrivals.select(*UID_KEY, content_key().alias("content"), "ord")
    stored = messages.select("account", content_key().alias("content"), "folder", "uid_validity", "uid", "id",
                             (F.col("stale") | F.col("folder_moved")).alias("asleep"), "is_canonical")
    return thin.groupBy(*CONTENT).transformWithStateInPandas(
        _Arrivals(), VERDICT, "append", "none", initialState=stored.groupBy(*CONTENT)).drop("content")


def decided(arrivals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Parsed arrivals with their verdicts, in the form that ingest.apply_arrivals and link_copies take."""
    names = ("account", "folder", "uid", "uid_validity")
    parts = (F.col("account"), F.col("leader_folder"), F.col("leader_uid"), F.col("leader_validity"))
    leader = F.when(F.col("leader_uid").isNotNull(), F.struct(*[p.alias(n) for p, n in zip(parts, names)]))
    told = verdicts.select(*UID_KEY, "action", "match_id", leader.alias("leader"), F.col("leader_uid").alias("batch_of"))
    return arrivals.dropDuplicates(UID_KEY).join(told, UID_KEY)


# --- timed release ---------------------------------------------------------------------------------------------

RELEASED = "queue_id long, state string, at timestamp"


#: Items are kept in so many buckets by the hash of their id; those without an id in one of their own.
BUCKETS = 4096
NO_ID = -1
#: Stands for a time that is not known.
NEVER = 1 << 62
ITEM = ["queue_id", "due", "withdrawn", "told", "wake"]


class _Release(StatefulProcessor):
    """State of a bucket of items: when each is due, when it was withdrawn, whether its end has been told, and when
    (in milliseconds) it is to be looked at again. One timer wakes the bucket for the first of them."""

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("item", "queue_id long, due long, withdrawn long, told boolean, wake long")

    def _held(self) -> pd.DataFrame:
        held = list(self.items.get()) if self.items.exists() else []
        return pd.DataFrame(held, columns=ITEM).astype({c: bool if c == "told" else "int64" for c in ITEM})

    def _keep(self, items: pd.DataFrame) -> None:
        first = [int(items.wake.min())] if len(items) else []
        if len(items):
            self.items.put(list(zip(*(items[c].tolist() for c in ITEM))))
        else:
            self.items.clear()
        timers = list(self.handle.listTimers())
        for old in timers:
            if old not in first:
                self.handle.deleteTimer(old)
        for at in first:
            if at not in timers:
                self.handle.registerTimer(at)

    def _end(self, key, items: pd.DataFrame, ends: pd.Series, state: str, at: str, now: int) -> pd.DataFrame:
        """Marks items as told, to be remembered for a while, so that a repeat does not start them again."""
        items.loc[ends, "told"] = True
        items.loc[ends, "wake"] = (items[at] // 1000).clip(lower=max(now, 0)) + self.remember_ms
        ended = items[ends]
        return pd.DataFrame({"queue_id": pd.array([None] * len(ended) if key[0] == NO_ID else ended.queue_id, "Int64"),
                             "state": state, "at": pd.to_datetime(ended[at].to_numpy(), unit="us", utc=True)})

    def handleInputRows(self, key, rows, timerValues):
        parts = [self._held()]
        for frame in rows:
            queued, at = frame.op == "queue", frame.at_us.astype("int64")
            parts.append(pd.DataFrame({"queue_id": frame.queue_id, "due": at.where(queued, NEVER),
                                       "withdrawn": at.where(~queued, NEVER), "told": False, "wake": NEVER}))
        known = parts[0].queue_id[parts[0].told]
        new = pd.concat(parts[1:])
        items = pd.concat([parts[0], new[~new.queue_id.isin(known)]]).groupby("queue_id", as_index=False).agg(
            {"due": "min", "withdrawn": "min", "told": "max", "wake": "min"})
        waits = ~items.told
        due = -(-items.due // 1000)  # timers count whole milliseconds; never before it is due
        items.loc[waits, "wake"] = due.where(items.due < NEVER, items.withdrawn // 1000 + self.remember_ms)
        ends = waits & (items.due < NEVER) & (items.withdrawn < items.due)
        out = self._end(key, items, ends, "cancelled", "withdrawn", timerValues.getCurrentWatermarkInMs())
        self._keep(items)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        items, now = self._held(), timerValues.getCurrentWatermarkInMs()
        waits = ~items.told & (items.due < NEVER)
        items = items[waits | (items.wake >= now)].reset_index(drop=True)
        ends = ~items.told & (items.due < NEVER) & (items.wake < now)
        out = self._end(key, items, ends, "dispatched", "due", now)
        self._keep(items)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def timed_release(operations: DataFrame, lateness: str = "0 seconds", remember_hours: int = 24) -> DataFrame:
    """Stream of what becomes of queued items: queue_id, state, at.

    operations: a stream of queue_id, op (queue, cancel), at (when to release, when withdrawn), ts (event time). An
    item is released when event time, less ``lateness``, passes the first time it was queued for, and leaves the state;
    a cancel for an earlier time removes it before. Each item ends once; it may be queued anew ``remember_hours`` after
    its end. A cancel without an item is forgotten as late. An operation without ``at`` says nothing.

    Items of one bucket are worked on together, as arrays: a micro-batch reads and writes the items that are held in the
    BUCKETS its rows fall in, not one item at a time.
    """
    bucket = F.when(F.col("queue_id").isNull(), F.lit(NO_ID)).otherwise(F.pmod(F.xxhash64("queue_id"), F.lit(BUCKETS)).cast("int"))
    ops = operations.withWatermark("ts", lateness).where(F.col("at").isNotNull()).select(
        bucket.alias("bucket"), F.coalesce("queue_id", F.lit(0)).cast("long").alias("queue_id"), "op", F.unix_micros("at").alias("at_us"), "ts")
    return ops.groupBy("bucket").transformWithStateInPandas(
        _Release(remember_hours * 3_600_000), RELEASED, "append", "eventtime")


def still_queued(spark: SparkSession, checkpoint: str) -> DataFrame:
    """queue_id, at of the items that wait in the state of a timed_release stream, read from its state store."""
    state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "item").load()
             .select("key.bucket", "list_element.*"))
    return state.where(~F.col("told") & (F.col("due") < NEVER)).select(
        F.when(F.col("bucket") != NO_ID, F.col("queue_id")).alias("queue_id"), F.timestamp_micros("due").alias("at"))


# --- audit on two time axes ------------------------------------------------------------------------------------


def audit_two_axes(messages: DataFrame, size: str = "24 hours", step: str = "1 hour", lateness: str = "1 day",
                   **counts: Column) -> DataFrame:
    """Messages of every sliding window by receipt or by fetch: window_end, n and the counts, for closed windows.

    messages: a stream with id, received_at, fetched_at and what the counts need. Both times are event times of their
    own, so a message that is fetched late still counts in the windows of its fetch. Where both times fall into one
    window, the message counts there once; a message that comes twice within ``lateness`` does so as well. Null times
    lie in no window.
    """
    flags = {k: c.alias(k) for k, c in counts.items()}

    def axis(ts: str) -> DataFrame:
        timed = messages.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
        return timed.select("id", F.window(ts, size, step).alias("w"), *flags.values())

    both = axis("received_at").unionByName(axis("fetched_at"))
    once = both.dropDuplicatesWithinWatermark(["id", "w"])
    return once.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in counts]).select(
        F.col("w.end").alias("window_end"), "n", *counts)


# --- sessions and joins ----------------------------------------------------------------------------------------


def sessions(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour",
             **sums: Column) -> DataFrame:
    """Runs of events of one key that follow each other within ``gap``: start, last and n of each closed session."""
    aggregates = [F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]]
    return (events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggregates)
            .select(*by, "start", "last", "n", *sums))


def followed(first: DataFrame, then: DataFrame, key: str, within_minutes: int, lateness: str = "1 hour") -> DataFrame:
    """Each event of ``first`` with those of ``then`` of the same key up to ``within_minutes`` later.

    Both are streams of ``key`` and ts. Time bounds let the join drop what can no longer meet. Events without one stay
    in the result with a null then_ts, once their time is over.
    """
    a = first.withWatermark("ts", lateness).select(F.col(key), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", lateness).select(F.col(key).alias("_key"), F.col("ts").alias("then_ts"))
    near = (F.col(key) == F.col("_key")) & (F.col("then_ts") >= F.col("first_ts")) & (
        F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {int(within_minutes)} MINUTES"))
    return a.join(b, near, "left_outer").drop("_key")
