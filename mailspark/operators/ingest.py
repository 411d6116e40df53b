"""Incremental ingest: which uids are new, which rows come back, which are copies, and the state that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark.functions.headers import is_seen
from mailspark.operators.store import added, last_write, newest, upsert
from mailspark.session import checkpointed

UID_KEY = ["account", "folder", "uid_validity", "uid"]
FOLDER = ["account", "folder"]


def folder_cursor(folders: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Per live folder the uid to start above, and whether its epoch changed. No state, or another epoch: from 0."""
    state = sync_state.select(*FOLDER, F.col("uid_validity").alias("s_validity"), "highest_uid", "syncs_since_full")
    changed = F.col("s_validity").isNotNull() & (F.col("s_validity") != F.col("uid_validity"))
    same = F.col("s_validity") == F.col("uid_validity")
    return folders.join(state, FOLDER, "left").select(
        *folders.columns, changed.alias("epoch_changed"),
        F.when(same, F.col("highest_uid")).otherwise(F.lit(0)).cast("long").alias("cursor"),
        F.when(same, F.col("syncs_since_full")).otherwise(F.lit(0)).cast("int").alias("syncs_since_full"))


def new_uids(raw: DataFrame, cursors: DataFrame, budget: int | None = None) -> DataFrame:
    """Raw rows above the cursor of their folder, oldest folders first when a budget is set; the rest waits.

    A folder whose next uid shows that nothing arrived is skipped. ``cursors`` has one row per folder.
    """
    gate = F.col("uid_next").isNull() | (F.col("uid_next") - 1 > F.col("cursor"))
    open_folders = cursors.where(gate).select(*FOLDER, "uid_validity", "cursor", "folder_ord")
    taken = raw.join(open_folders, [*FOLDER, "uid_validity"]).where(F.col("uid") > F.col("cursor"))
    if budget is not None:
        taken = taken.orderBy("folder_ord", "account", "folder", "uid").limit(budget)
    return taken.drop("cursor")


def advance(sync_state: DataFrame, cursors: DataFrame, taken: DataFrame, now: Column) -> DataFrame:
    """The state after a run: the cursor moves to the highest uid taken and never back."""
    tops = taken.groupBy(*FOLDER).agg(F.max("uid").alias("top"))
    fresh = cursors.join(tops, FOLDER, "left").select(
        *FOLDER, "uid_validity", F.greatest("cursor", F.coalesce("top", F.lit(0))).alias("highest_uid"),
        (F.col("syncs_since_full") + 1).cast("int").alias("syncs_since_full"), now.alias("last_sync_at"),
        F.when(F.col("epoch_changed"), now).alias("last_full_sync_at"))
    return upsert(sync_state, fresh, FOLDER)


def compensation_due(sync_state: DataFrame, now: Column, scans: int, hours: int = 24) -> DataFrame:
    """Folders whose last days should be read again: enough increments, or the last full read is too old."""
    late = F.col("last_full_sync_at").isNotNull() & (now - F.col("last_full_sync_at") > F.make_dt_interval(hours=F.lit(hours)))
    return sync_state.withColumn("due", F.coalesce((F.col("syncs_since_full") >= scans) | late, F.lit(False)))


def mark_stale(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows of folders whose epoch changed become stale; nothing is deleted."""
    changed = cursors.where("epoch_changed").select(*FOLDER, F.lit(True).alias("_reset"))
    return messages.join(changed, FOLDER, "left").withColumn(
        "stale", F.col("stale") | F.coalesce("_reset", F.lit(False))).drop("_reset")


def mark_moved(messages: DataFrame, present: DataFrame) -> DataFrame:
    """Known rows of a live folder epoch whose uid is gone from the folder's listing."""
    live = present.select(*FOLDER, "uid_validity").distinct().withColumn("_live", F.lit(True))
    seen = present.select(*UID_KEY).distinct().withColumn("_seen", F.lit(True))
    joined = messages.join(live, [*FOLDER, "uid_validity"], "left").join(seen, UID_KEY, "left")
    gone = F.col("_live").isNotNull() & F.col("_seen").isNull() & ~F.col("folder_moved")
    return joined.withColumn("folder_moved", F.col("folder_moved") | gone).select(*messages.columns)


def _lowest(pool: DataFrame, key: str, keys: list[str], name: str) -> DataFrame:
    return pool.where(F.length(key) > 0).groupBy(*keys, key).agg(F.min("id").alias(name))


def _woken(arrivals: DataFrame, asleep: DataFrame, key: str) -> DataFrame:
    """_place, re_id: the k-th arrival of a key takes the k-th sleeping row of that key in its folder."""
    by = [*FOLDER, key]
    waiting = asleep.where(F.length(key) > 0).select(
        *by, F.col("id").alias("re_id"), F.row_number().over(Window.partitionBy(*by).orderBy("id")).alias("_k"))
    come = arrivals.where(F.length(key) > 0).select(
        *by, "_place", F.row_number().over(Window.partitionBy(*by).orderBy("_place")).alias("_k"))
    return come.join(waiting, [*by, "_k"]).select("_place", "re_id")


def _touched(messages: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The stored rows that share a uid, a body hash or a message id with some arrival, as thin rows: one pass over
    the stored table, so what follows costs as much as the batch."""
    hashed, named = "body_sha256", "normalized_message_id"

    def keys(df: DataFrame, *columns: str) -> DataFrame:
        uid = F.concat_ws("\x1f", F.lit("u"), *[F.col(k).cast("string") for k in UID_KEY])
        other = [F.when(F.length(c) > 0, F.concat_ws("\x1f", F.lit(c), "account", c)) for c in (hashed, named)]
        return df.select(*columns, F.explode(F.array(uid, *other)).alias("_key")).where("_key is not null")

    thin = keys(messages, *UID_KEY, "id", "stale", "folder_moved", "is_canonical", hashed, named)
    wanted = keys(arrivals).distinct()
    return checkpointed(thin.join(wanted, "_key", "left_semi").drop("_key").dropDuplicates(["id"]))


def classify_arrivals(arrivals: DataFrame, messages: DataFrame) -> DataFrame:
    """Decide what each parsed arrival is: known, reactivated, copy or new.

    Content hash counts before message id. A sleeping row is taken by one arrival only, the lowest id first; arrivals
    that find no row left go on as copies or new rows, so none is lost. Copies inside the batch itself follow its
    order. Adds ``action``, ``match_id`` (stored row) and ``batch_of`` (arrival it copies).
    """
    hashed, named = "body_sha256", "normalized_message_id"
    leading = ["folder_ord"] if "folder_ord" in arrivals.columns else []
    place = F.struct(*leading, *[k for k in UID_KEY if k != "uid_validity"], "uid_validity")
    messages = _touched(messages, arrivals)
    known = messages.select(*UID_KEY, F.col("id").alias("known_id"))
    canonical = messages.where("is_canonical")
    joined = (arrivals.dropDuplicates(UID_KEY).withColumn("_place", place).join(known, UID_KEY, "left")
              .join(_lowest(canonical, hashed, ["account"], "dup_hash"), ["account", hashed], "left")
              .join(_lowest(canonical, named, ["account"], "dup_name"), ["account", named], "left"))
    # settled once: all that follows must see the same rows
    joined = checkpointed(joined)
    asleep = messages.where("stale or folder_moved").select(*FOLDER, "id", hashed, named)
    open_ = joined.where("known_id is null").select(*FOLDER, "_place", hashed, named)
    by_hash = checkpointed(_woken(open_, asleep, hashed))
    by_name = _woken(open_.join(by_hash, "_place", "left_anti"),
                     asleep.join(by_hash.select(F.col("re_id").alias("id")), "id", "left_anti"), named)
    duplicate = F.least("dup_hash", "dup_name")
    first = (F.when(F.col("known_id").isNotNull(), "known").when(F.col("re_id").isNotNull(), "reactivated")
             .when(duplicate.isNotNull(), "copy").otherwise("new"))
    staged = checkpointed(joined.join(by_hash.unionByName(by_name), "_place", "left").withColumn("_first", first)
                          .withColumn("match_id", F.coalesce("known_id", "re_id", duplicate))
                          .drop("known_id", "re_id", "dup_hash", "dup_name"))
    return _copies_within(staged)


def _copies_within(staged: DataFrame) -> DataFrame:
    """Arrivals that match nothing stored: an arrival is new unless an earlier new one shares its hash or its id.

    A copy stands for nothing, so who is new depends on who came before. Each round settles every arrival that is
    first in both of its groups, and the copies of those; the rest goes on. One round is the rule, more are needed
    only where chains of partly equal arrivals meet in one batch.
    """
    hashed = F.when(F.length("body_sha256") > 0, F.col("body_sha256"))
    named = F.when(F.length("normalized_message_id") > 0, F.col("normalized_message_id"))
    # a message without body and without id is like no other, and new as it is
    rest = checkpointed(staged.where("_first = 'new'").where(hashed.isNotNull() | named.isNotNull()).select(
        "account", hashed.alias("_h"), named.alias("_m"), "_place"))
    settled: list[DataFrame] = []
    while not rest.isEmpty():
        by_hash = rest.where("_h is not null").groupBy("account", "_h").agg(F.min("_place").alias("h_first"))
        by_name = rest.where("_m is not null").groupBy("account", "_m").agg(F.min("_place").alias("m_first"))
        placed = rest.join(by_hash, ["account", "_h"], "left").join(by_name, ["account", "_m"], "left")
        leads = (F.coalesce("h_first", "_place") == F.col("_place")) & (F.coalesce("m_first", "_place") == F.col("_place"))
        leaders = checkpointed(placed.where(leads).select("account", "_h", "_m", "_place"))
        of_hash = leaders.where("_h is not null").select("account", "_h", F.col("_place").alias("h_of"))
        of_name = leaders.where("_m is not null").select("account", "_m", F.col("_place").alias("m_of"))
        judged = checkpointed(rest.join(of_hash, ["account", "_h"], "left").join(of_name, ["account", "_m"], "left")
                              .withColumn("_of", F.least("h_of", "m_of")))
        settled.append(judged.where("_of is not null").select("account", "_place", "_of"))
        rest = judged.where("_of is null").select("account", "_h", "_m", "_place")
    if not settled:
        return staged.withColumns({"leader": F.lit(None).cast(staged.schema["_place"].dataType),
                                   "batch_of": F.lit(None).cast("long"), "action": F.col("_first")}).drop("_first", "_place")
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    copy = F.coalesce(F.col("_of") < F.col("_place"), F.lit(False))
    return (staged.join(found, ["account", "_place"], "left")
            .withColumn("leader", F.when(copy, F.col("_of"))).withColumn("batch_of", F.col("leader.uid"))
            .withColumn("action", F.when(copy, "copy").otherwise(F.col("_first")))
            .drop("_first", "_place", "_of"))


def apply_arrivals(messages: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Messages after a batch: flags refreshed, sleeping rows brought back under their new uid, new rows added.

    A row that comes back keeps its id and extraction status, so its events stay attached and it is not read twice.
    """
    woken = (decided.where("action = 'reactivated'").groupBy(F.col("match_id").alias("id"))
             .agg(F.min(F.struct(*UID_KEY, "flags")).alias("_w")))
    known = decided.where("action = 'known'").select(F.col("match_id").alias("id"), F.col("flags").alias("_f"))
    base = messages.join(woken, "id", "left").join(known, "id", "left")
    back = F.col("_w").isNotNull()
    updates = {k: F.coalesce(F.col(f"_w.{k}"), F.col(k)) for k in UID_KEY}
    updates.update({
        "flags": F.coalesce("_w.flags", "_f", "flags"), "stale": F.col("stale") & ~back,
        "folder_moved": F.col("folder_moved") & ~back,
        "moved_to_folder": F.when(~back, F.col("moved_to_folder")),
        "fetched_at": F.when(back, now).otherwise(F.col("fetched_at"))})
    kept = base.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in messages.columns])
    copy = F.col("action") == "copy"
    made = {
        "id": F.lit(None).cast("long"), "is_canonical": ~copy, "duplicate_of": F.when(copy, F.col("match_id")),
        "stale": F.lit(False), "folder_moved": F.lit(False), "fetched_at": now, "extract_attempts": F.lit(0),
        "extract_status": F.when(copy, "done").otherwise("pending"), "body_purged": F.lit(False)}
    types = {f.name: f.dataType for f in messages.schema}
    fresh = decided.where("action in ('new', 'copy')")
    added_rows = fresh.select(*[
        (made[c] if c in made else F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c)
        for c in messages.columns])
    return kept.unionByName(added_rows)


def link_copies(numbered: DataFrame, decided: DataFrame) -> DataFrame:
    """Point copies that arrived together with their original to it, once the original has an id."""
    copies = decided.where("leader is not null").select(
        *UID_KEY, *[F.col(f"leader.{k}").alias(f"l_{k}") for k in UID_KEY])
    ids = numbered.select(*[F.col(k).alias(f"l_{k}") for k in UID_KEY], F.col("id").alias("l_id"))
    leaders = copies.join(ids, [f"l_{k}" for k in UID_KEY]).select(*UID_KEY, "l_id")
    return numbered.join(leaders, UID_KEY, "left").withColumn("duplicate_of", F.coalesce("duplicate_of", "l_id")).select(
        *numbered.columns)


def ledger(processed: DataFrame, log: DataFrame) -> DataFrame:
    """The ingest ledger: synced or fetch_failed per uid, last write wins."""
    changes = last_write(log, UID_KEY, "processed_at")

    def replace(old: Column, new: Column) -> Column:
        # an error is cleared by a later success, so null must win when a change exists
        return F.when(F.col("n.processed_at").isNotNull(), new).otherwise(old)

    return upsert(processed, changes, UID_KEY, {"error": replace})


def sender_rollup(arrivals: DataFrame) -> DataFrame:
    """Per account and address: totals, unread, last name seen, last date, any unsubscribe header."""
    by = F.struct("sent_at", "uid")
    return (arrivals.where(F.length("from_addr") > 0)
            .groupBy("account", F.lower("from_addr").alias("addr"))
            .agg(F.max_by("from_name", F.when(F.length("from_name") > 0, by)).alias("name"),
                 F.count(F.lit(1)).alias("total"), F.count_if(~is_seen(F.col("flags"))).alias("unread"),
                 F.lit(0).cast("long").alias("replied_count"), F.max("sent_at").alias("last_seen_at"),
                 F.max("has_unsubscribe").alias("has_unsubscribe")))


def merge_senders(senders: DataFrame, rollup: DataFrame) -> DataFrame:
    """Last seen is the latest date, not the last one written."""
    return upsert(senders, rollup, ["account", "addr"], {
        "total": added, "unread": added, "replied_count": added, "name": newest,
        "last_seen_at": lambda o, n: F.greatest(o, n),
        "has_unsubscribe": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False))})


def replied_counts(messages: DataFrame, own_addresses: list[str]) -> DataFrame:
    """Contacts: in how many threads the user wrote after an address had written there."""
    own = [a.lower() for a in own_addresses]
    addr = F.lower("from_addr")
    first_in = messages.where(~addr.isin(*own)).groupBy("account", "thread_id", addr.alias("addr")).agg(
        F.min("received_at").alias("first_at"))
    sent = messages.where(addr.isin(*own)).groupBy("account", "thread_id").agg(F.max("received_at").alias("sent_at"))
    return (first_in.join(sent, ["account", "thread_id"]).where("sent_at > first_at")
            .groupBy("account", "addr").agg(F.count(F.lit(1)).alias("replied_count")))


# --- extraction status ----------------------------------------------------------------------------------------


def reclaim(messages: DataFrame, now: Column, zombie_minutes: int = 60, max_attempts: int = 3) -> DataFrame:
    """Rows stuck in running go back to pending; rows out of attempts fail for good."""
    stuck = (F.col("extract_status") == "running") & (
        F.col("fetched_at").isNull() | (F.col("fetched_at") <= now - F.make_dt_interval(mins=F.lit(zombie_minutes))))
    status = F.when(stuck, "pending").otherwise(F.col("extract_status"))
    spent = (status == "pending") & (F.col("extract_attempts") >= max_attempts)
    return messages.withColumn("extract_status", F.when(spent, "failed").otherwise(status))


def claim(messages: DataFrame, limit: int | None = None, account: str | None = None) -> DataFrame:
    """The next canonical pending rows by id, as running; all of them without a limit."""
    rows = messages.where("extract_status = 'pending' and is_canonical")
    if account is not None:
        rows = rows.where(F.col("account") == account)
    rows = rows if limit is None else rows.orderBy("id").limit(limit)
    return rows.withColumn("extract_status", F.lit("running"))


def after_attempt(messages: DataFrame, failed: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Status after a run: failures count up and return to pending until their attempts are used."""
    marks = failed.select("id").distinct().withColumn("_failed", F.lit(True))
    joined = messages.join(marks, "id", "left")
    attempts = F.col("extract_attempts") + F.when(F.col("_failed").isNotNull(), 1).otherwise(0)
    running = F.col("extract_status") == "running"
    return joined.withColumns({
        "extract_attempts": attempts.cast("int"),
        "extract_status": F.when(running & F.col("_failed").isNull(), "done")
        .when(running, F.when(attempts >= max_attempts, "failed").otherwise("pending"))
        .otherwise(F.col("extract_status"))}).drop("_failed")
