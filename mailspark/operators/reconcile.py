"""Approved events against their external copies: three-way comparison, action plan, and the state that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions import payload as pl
from mailspark.functions.common import with_once
from mailspark.operators.rules import DEFAULT_ZONE


def remote_copies(payloads: DataFrame, listing: bool = False, key: str = pl.OWNER_KEY) -> DataFrame:
    """Remote snapshot rows with owner, canonical form and hash. A listing leaves cancelled entries out; a lookup
    by key keeps them."""
    read = with_once(payloads, p=pl.parse_payload(F.col("payload")))
    if listing:
        read = read.where(F.coalesce(F.col("p.status"), F.lit("")) != "cancelled")
    formed = with_once(read, remote_form=pl.canonical(F.col("p"), key))
    return formed.select("event_id", "etag", F.col("payload").alias("remote_payload"),
                         pl.owner_of(F.col("p"), key).alias("owner"), "remote_form",
                         pl.canonical_hash(F.col("remote_form")).alias("remote_hash"))


def local_payloads(events: DataFrame, tz: str = DEFAULT_ZONE, key: str = pl.OWNER_KEY) -> DataFrame:
    """Events with ``owner_key``, the payload they would be written with, and its hash."""
    owner = F.coalesce(F.when(F.length("fingerprint") > 0, F.col("fingerprint")),
                       F.concat(F.lit("event-"), F.col("id").cast("string")))
    built = with_once(
        events.withColumn("owner_key", owner),
        local_struct=pl.build_payload(
            F.col("title"), F.col("start_ts"), F.col("end_ts"), F.col("all_day"), F.col("owner_key"), F.col("location"),
            pl.stable_description(F.col("snapshot_payload"), F.col("evidence"), F.col("source")), tz, key))
    return (built.withColumn("local_payload", F.to_json("local_struct"))
            .withColumn("local_hash", pl.canonical_hash(pl.canonical(F.col("local_struct"), key))).drop("local_struct"))


def verdict(exists: Column, owner: Column, expected_owner: Column, etag: Column, last_etag: Column,
            remote_hash: Column, snapshot_hash: Column, local_hash: Column) -> Column:
    """The ordered ownership tests; only an entry that is ours and unchanged by others may be written."""
    unchanged = (F.length(last_etag) > 0) & (F.length(etag) > 0) & (etag == last_etag)
    return (F.when(~F.coalesce(exists, F.lit(False)), "not_found")
            .when((F.length(expected_owner) > 0) & ~owner.eqNullSafe(expected_owner), "not_owned")
            .when(F.coalesce(unchanged, F.lit(False)), "no_change")
            .when((F.length(snapshot_hash) > 0) & (remote_hash == snapshot_hash), "benign_evolution")
            .when(local_hash.isNotNull() & snapshot_hash.isNotNull() & (local_hash != snapshot_hash), "conflict")
            .otherwise("externally_modified"))


def verdict_reason(code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in lx.VERDICT_REASONS.items()])


def compare(local: DataFrame, remote: DataFrame, key: str = pl.OWNER_KEY) -> DataFrame:
    """Local rows (owner_key, local_hash, snapshot_hash, ...) against remote copies by external id."""
    joined = local.join(remote.withColumnRenamed("event_id", "gcal_event_id"), "gcal_event_id", "left")
    code = verdict(F.col("remote_hash").isNotNull(), F.col("owner"), F.col("owner_key"), F.col("etag"),
                   F.col("gcal_etag"), F.col("remote_hash"), F.col("snapshot_hash"), F.col("local_hash"))
    judged = with_once(joined, verdict=code, snapshot_form=pl.canonical(
        pl.parse_payload(F.col("snapshot_payload")), key))
    frozen = F.col("verdict").isin("conflict", "externally_modified")
    return with_once(judged, differences=F.when(frozen, pl.diff(F.col("snapshot_form"), F.col("remote_form")))).withColumn(
        "detail", pl.describe(verdict_reason(F.col("verdict")), F.coalesce(
            "differences", F.expr("cast(array() as array<struct<field:string,mine:string,theirs:string>>)"))))


def push_plan(events: DataFrame, payloads: DataFrame, limit: int | None = None, not_found_policy: str = "pending",
              tz: str = DEFAULT_ZONE, key: str = pl.OWNER_KEY) -> DataFrame:
    """What a push would do to each approved event: create, backfill, update, skip, freeze, missing or recreate.

    An event without an external id whose mark is already out there is adopted instead of written twice. A run
    takes all of them, or the first ``limit`` by start; ``limit_hit`` rows wait.
    """
    approved = events.where("status = 'approved'")
    due = approved if limit is None else approved.orderBy(F.asc_nulls_first("start_ts"), "id").limit(limit)
    local = local_payloads(due, tz, key)
    remote = remote_copies(payloads, key=key)
    judged = compare(local.where("gcal_event_id is not null"), remote, key).withColumn(
        "action", F.when(F.col("verdict") == "not_found", F.lit("recreate" if not_found_policy == "recreate" else "missing"))
        .when(F.col("verdict").isin("not_owned", "conflict", "externally_modified"), "freeze")
        .when(F.col("verdict") == "no_change", "skip").otherwise("update"))
    marks = remote.where("owner is not null").groupBy(F.col("owner").alias("owner_key")).agg(
        F.min(F.struct("event_id", "etag", "remote_hash", "remote_payload")).alias("m"))
    fresh = local.where("gcal_event_id is null").join(marks, "owner_key", "left").withColumns({
        "verdict": F.lit(None).cast("string"), "detail": F.lit(None).cast("string"),
        "action": F.when(F.col("m").isNotNull(), "backfill").otherwise("create"),
        "etag": F.col("m.etag"), "remote_hash": F.col("m.remote_hash"), "remote_payload": F.col("m.remote_payload"),
        "found_id": F.col("m.event_id")})
    columns = ["id", "owner_key", "action", "verdict", "detail", "local_payload", "local_hash", "etag", "remote_hash",
               "remote_payload", "found_id"]
    return judged.withColumn("found_id", F.col("gcal_event_id")).select(*columns).unionByName(fresh.select(*columns))


def apply_plan(events: DataFrame, plan: DataFrame, now: Column, written: DataFrame | None = None) -> DataFrame:
    """The events table after a push. ``written`` (id, event_id, etag, remote_hash) tells what the outbox's
    consumer stored; without it creates and updates stay approved."""
    steps = plan.select("id", F.struct(*[c for c in plan.columns if c != "id"]).alias("p"))
    joined = events.join(steps, "id", "left")
    if written is not None:
        joined = joined.join(written.select("id", F.struct("event_id", "etag", "remote_hash").alias("w")), "id", "left")
    else:
        joined = joined.withColumn("w", F.lit(None).cast("struct<event_id:string,etag:string,remote_hash:string>"))
    act = F.col("p.action")
    sent = act.isin("create", "update") & F.col("w").isNotNull()
    back, frozen, gone, again, skip = (act == a for a in ("backfill", "freeze", "missing", "recreate", "skip"))
    conflict = F.col("p.verdict") == "conflict"
    pushed = F.coalesce(sent | back, F.lit(False))
    touched = F.coalesce(pushed | frozen | skip, F.lit(False))
    new = {
        "status": F.when(pushed, "pushed").when(frozen & conflict, "conflict").when(frozen, "externally_modified")
        .when(gone, "missing").otherwise(F.col("status")),
        "gcal_event_id": F.when(again, F.lit(None)).when(sent, F.col("w.event_id")).when(back, F.col("p.found_id"))
        .otherwise(F.col("gcal_event_id")),
        "gcal_etag": F.when(again, F.lit(None)).when(sent, F.col("w.etag")).when(back | frozen | skip, F.col("p.etag"))
        .otherwise(F.col("gcal_etag")),
        "snapshot_hash": F.when(again, F.lit(None)).when(sent, F.col("w.remote_hash")).when(back, F.col("p.remote_hash"))
        .otherwise(F.col("snapshot_hash")),
        "snapshot_payload": F.when(again, F.lit(None)).when(sent, F.col("p.local_payload"))
        .when(back, F.col("p.remote_payload")).otherwise(F.col("snapshot_payload")),
        "remote_norm_hash": F.when(sent, F.col("w.remote_hash")).when(back | frozen, F.col("p.remote_hash"))
        .otherwise(F.col("remote_norm_hash")),
        "managed_state": F.when(pushed, "owned").when(frozen, "frozen").otherwise(F.col("managed_state")),
        "needs_attention": F.when(pushed | F.coalesce(again, F.lit(False)), False).when(frozen | gone, True)
        .otherwise(F.col("needs_attention")),
        "last_checked_at": F.when(touched, now).otherwise(F.col("last_checked_at")),
        "updated_at": F.when(act.isNotNull(), now).otherwise(F.col("updated_at")),
        "evidence": F.when(frozen, F.concat(F.coalesce("evidence", F.lit("")), F.lit("\n[冻结："), F.col("p.detail"),
                                            F.lit("]"))).otherwise(F.col("evidence")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def removal_plan(events: DataFrame, ids: DataFrame, payloads: DataFrame, hard: bool = False,
                 key: str = pl.OWNER_KEY) -> DataFrame:
    """Archive (default) or delete: what happens to each named event, here and outside."""
    mine = ids.select("id").distinct().join(events.select("id", "gcal_event_id", "fingerprint", F.lit(True).alias("_e")),
                                            "id", "left")
    remote = remote_copies(payloads, key=key).select(F.col("event_id").alias("gcal_event_id"), "owner",
                                                     F.lit(True).alias("_r"))
    joined = mine.join(remote, "gcal_event_id", "left")
    unsent = F.coalesce(F.length("gcal_event_id"), F.lit(0)) == 0
    action = (F.when(F.col("_e").isNull(), "not_found")
              .when(unsent, F.lit("refuse" if hard else "cancel_local"))
              .when(F.col("_r").isNull(), F.lit("skip" if hard else "cancel_local"))
              .when(~F.col("owner").eqNullSafe(F.col("fingerprint")), "refuse")
              .otherwise("delete_remote" if hard else "cancel_remote"))
    return joined.select("id", action.alias("action"))


def apply_removal(events: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    joined = events.join(plan.select("id", F.col("action").alias("_a")), "id", "left")
    done = F.col("_a").isin("cancel_local", "cancel_remote", "delete_remote")
    new = {"status": F.when(done, "cancelled").otherwise(F.col("status")),
           "gcal_event_id": F.when(F.col("_a") == "delete_remote", F.lit(None)).otherwise(F.col("gcal_event_id")),
           "gcal_etag": F.when(F.col("_a") == "cancel_remote", F.lit(None)).otherwise(F.col("gcal_etag")),
           "updated_at": F.when(done, now).otherwise(F.col("updated_at"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def record_failures(events: DataFrame, failures: DataFrame, max_attempts: int, now: Column) -> DataFrame:
    """Count failed pushes up; at the limit the event asks for attention."""
    counts = failures.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = events.join(counts, "id", "left")
    hit = F.col("_n").isNotNull()
    attempts = F.coalesce("push_attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))
    new = {"push_attempts": attempts.cast("int"), "status": F.when(hit, "push_failed").otherwise(F.col("status")),
           "needs_attention": F.when(hit, attempts >= max_attempts).otherwise(F.col("needs_attention")),
           "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def push_stats(plan: DataFrame, considered_total: int | None = None) -> DataFrame:
    """Counters of a plan; ``limit_hit`` is what the limit left behind."""
    counts = {a: F.count_if(F.col("action") == a).alias(a) for a in (
        "create", "backfill", "update", "skip", "freeze", "missing", "recreate")}
    out = plan.agg(F.count(F.lit(1)).alias("considered"), *counts.values())
    total = F.lit(considered_total).cast("long") if considered_total is not None else F.col("considered")
    return out.withColumn("limit_hit", total - F.col("considered"))
