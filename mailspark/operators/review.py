"""The review queue and its state machine: commands are a table, every transition is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import local_day, strip
from mailspark.functions.fingerprint import title_tokens
from mailspark.operators.rules import DEFAULT_ZONE
from mailspark.session import checkpointed

TARGETS = {"approve": "approved", "reject": "rejected", "ignore": "ignored"}
HUMAN_FIELDS = ("title", "start_ts", "end_ts", "location")


# --- lists ----------------------------------------------------------------------------------------------------


def status_filter(events: DataFrame, which: str) -> DataFrame:
    """One status, or the groups frozen, failed and all. Unknown names are an error."""
    if which == "all":
        return events
    groups = {"frozen": lx.NEEDS_RULING_STATUSES, "failed": ("push_failed", "uncertain")}
    wanted = groups.get(which, (which,))
    if not set(wanted) <= set(lx.EVENT_STATUSES):
        raise ValueError(f"unknown event status: {which}")
    return events.where(F.col("status").isin(*wanted))


def split_reason(evidence: Column) -> tuple[Column, Column]:
    """(review reason, evidence without it) of a stored evidence text."""
    text = F.coalesce(evidence, F.lit(""))
    marked = text.rlike(r"(?s)^\[待审：[^\]]*\]")
    reason = F.regexp_extract(text, r"(?s)^\[待审：([^\]]*)\]", 1)
    rest = strip(F.regexp_replace(text, r"(?s)^\[待审：[^\]]*\]", ""))
    return F.when(marked, reason).otherwise(F.lit("")), F.when(marked, rest).otherwise(text)


def review_items(events: DataFrame, messages: DataFrame, statuses: tuple[str, ...] = ("pending",),
                 limit: int | None = None, since: Column | None = None) -> DataFrame:
    """Events with their message, soonest first. A page of ``limit`` is cut before the join, so only its rows travel."""
    page = events.where(F.col("status").isin(*statuses))
    if since is not None:
        page = page.where(F.col("created_at") >= since)
    if limit is not None:
        page = page.orderBy(F.asc_nulls_first("start_ts"), "id").limit(limit)
    mail = messages.select(F.col("id").alias("message_id"), F.col("subject").alias("mail_subject"),
                           F.col("from_addr").alias("mail_from"), F.col("received_at").alias("mail_received"))
    reason, evidence = split_reason(F.col("evidence"))
    return (page.join(mail, "message_id", "left").withColumn("review_reason", reason)
            .withColumn("evidence", evidence).orderBy(F.asc_nulls_first("start_ts"), "id"))


def sibling_counts(events: DataFrame, tz: str = DEFAULT_ZONE, minutes: int = lx.CONFLICT_MINUTES) -> DataFrame:
    """Per event: how many others of its message and local day exclude it (conflicts) or go with it (siblings).

    Counted over distinct start times, of which a day has a bounded number, so a message with very many events
    neither forms one huge group nor a pair per two of its events.
    """
    keyed = events.where("start_ts is not null and message_id is not null").select(
        "id", "message_id", local_day(F.col("start_ts"), tz).alias("day"), "all_day",
        F.unix_timestamp("start_ts").alias("sec"))
    slots = keyed.groupBy("message_id", "day", "sec").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("all_day")).alias("timed"))
    group = Window.partitionBy("message_id", "day")
    near = group.orderBy("sec").rangeBetween(-minutes * 60, minutes * 60)
    counted = slots.select(
        "message_id", "day", "sec", F.sum("n").over(group).alias("all_n"), F.sum("timed").over(group).alias("timed_n"),
        F.sum("timed").over(near).alias("near_timed"))
    joined = keyed.join(counted, ["message_id", "day", "sec"])
    # an all-day event never conflicts with the row that looks at it
    conflicts = F.col("timed_n") - F.col("near_timed")
    return joined.select("id", conflicts.alias("conflicts"), (F.col("all_n") - 1 - conflicts).alias("siblings"))


def sibling_rows(page: DataFrame, events: DataFrame, tz: str = DEFAULT_ZONE,
                 minutes: int = lx.CONFLICT_MINUTES) -> DataFrame:
    """(id, other, kind) behind the counts, for the rows of one page only.

    One row per event and page row of a day; a page with many rows is joined in the shuffle like any other table.
    """
    mine = page.select(F.col("id").alias("own"), "message_id", local_day(F.col("start_ts"), tz).alias("day"),
                       F.col("start_ts").alias("own_start"))
    others = events.select("id", "message_id", "start_ts", "all_day", local_day(F.col("start_ts"), tz).alias("day"))
    pairs = others.join(mine, ["message_id", "day"]).where("id <> own")
    far = F.abs(F.unix_timestamp("start_ts") - F.unix_timestamp("own_start")) > minutes * 60
    return pairs.select(F.col("own").alias("id"), F.col("id").alias("other"),
                        F.when(far & ~F.col("all_day"), "conflict").otherwise("sibling").alias("kind"))


def review_page(events: DataFrame, messages: DataFrame, limit: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(review items with their numbers of conflicts and siblings, the rows behind these numbers)."""
    items = review_items(events, messages, limit=limit, **options)
    behind = sibling_rows(items, events)
    counts = behind.groupBy("id").agg(F.count_if(F.col("kind") == "conflict").alias("conflicts"),
                                      F.count_if(F.col("kind") == "sibling").alias("siblings"))
    page = items.join(counts, "id", "left").na.fill(0, ["conflicts", "siblings"])
    return page.orderBy(F.asc_nulls_first("start_ts"), "id"), behind


def probable_duplicates(items: DataFrame, block: str, order: str, title: str, threshold: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
    """(row, first earlier row of its block with a similar title, similarity): a hint, never a merge.

    Equal token sets collapse first, so any number of copies costs one row. Two sets can only be similar enough
    when the smaller one shares a token among its rarest few; those few are the join keys, every pair found is
    checked in full, and no pair is left out.
    """
    rows = items.select(F.col(block).alias("block"), F.col(order).alias("ord"),
                        F.array_sort(title_tokens(F.col(title))).alias("toks"))
    rows = checkpointed(rows.where((F.size("toks") > 0) & F.col("block").isNotNull()))
    sets = checkpointed(rows.groupBy("block", "toks").agg(F.min("ord").alias("first"))
                        .withColumn("sid", F.xxhash64("block", "toks")))
    tokens = sets.select("block", "toks", "first", F.explode("toks").alias("tok"))
    freq = tokens.groupBy("block", "tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = (tokens.join(freq, ["block", "tok"])
              .groupBy("block", "toks").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(
                  F.struct("df", "tok"))).alias("by_rarity")))
    size = F.size("toks")
    prefix = (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    probes = ranked.select("block", F.col("toks").alias("small"), F.col("first").alias("small_first"),
                           F.explode(F.slice("by_rarity", F.lit(1), prefix)).alias("r")).select(
        "block", "small", "small_first", F.col("r.tok").alias("tok"))
    shared = F.size(F.array_intersect("small", "toks"))
    pairs = (probes.join(tokens, ["block", "tok"])
             .where((F.size("small") <= F.size("toks")) & (F.col("small") != F.col("toks")))
             .withColumn("sim", shared / F.size("small")).where(F.col("sim") >= threshold))
    hits = pairs.select("block", "small", "toks", "small_first", "first", "sim")
    # each pair serves whichever side is later in the list
    best = F.min(F.struct(F.col("earlier").alias("e"), F.col("sim").alias("s"))).alias("m")
    directed = hits.select("block", F.col("small").alias("toks"), F.col("first").alias("earlier"), "sim").unionByName(
        hits.select("block", "toks", F.col("small_first").alias("earlier"), "sim"))
    nearest = directed.groupBy("block", "toks").agg(best)
    joined = (rows.join(sets.select("block", "toks", "first"), ["block", "toks"])
              .join(nearest, ["block", "toks"], "left"))
    own = F.when(F.col("first") < F.col("ord"), F.struct(F.col("first").alias("e"), F.lit(1.0).alias("s")))
    other = F.when(F.col("m.e") < F.col("ord"), F.col("m"))
    found = F.least(own, other)
    return joined.withColumn("_f", found).where(F.col("_f").isNotNull()).select(
        F.col("block").alias(block), F.col("ord").alias(order), F.col("_f.e").alias("duplicate_of"),
        F.round("_f.s", 2).alias("similarity"))


# --- commands -------------------------------------------------------------------------------------------------

_ID_OR_RANGE = r"^(?:\d{1,18}(?:\s*-\s*\d{1,18})?)?$"
#: Ids of a range that one row carries at a time.
_RANGE_BLOCK = 1 << 16


def expand_ids(commands: DataFrame) -> DataFrame:
    """Commands (one per ``seq``) with ``event_ids`` text ('1,2,5-7') as one row per id, in order of ``pos``, without
    repeats.

    A range may be written backwards. It is cut into blocks that are dealt out before their ids are listed, so a
    range of any length is spread over the tasks. Text that is no list of ids is an error and stops the job.
    """
    parts = F.transform(F.split("event_ids", ","), strip)
    wrong = F.exists(parts, lambda p: ~p.rlike(_ID_OR_RANGE))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("cannot read event ids: "), F.col("event_ids")))).otherwise(parts)

    def span(part: Column) -> Column:
        left = F.regexp_extract(part, r"^(\d+)", 1).cast("long")
        right = F.regexp_extract(part, r"(\d+)$", 1).cast("long")
        return F.struct(F.least(left, right).alias("low"), F.greatest(left, right).alias("high"))

    spans = F.transform(F.filter(checked, lambda p: F.length(p) > 0), span)
    before = F.transform("_spans", lambda s, i: F.aggregate(
        F.slice("_spans", 1, i), F.lit(0).cast("long"), lambda n, t: n + t["high"] - t["low"] + 1))
    listed = commands.withColumn("_spans", spans).select(
        *commands.columns, F.inline(F.arrays_zip("_spans", before.alias("before"))))
    blocks = listed.withColumn("_from", F.explode(F.sequence(F.col("_spans.low"), F.col("_spans.high"), F.lit(_RANGE_BLOCK))))
    dealt = blocks.repartition("seq", "_from")
    ids = dealt.withColumn("id", F.explode(F.sequence("_from", F.least(F.col("_from") + _RANGE_BLOCK - 1, F.col("_spans.high")))))
    placed = ids.withColumn("pos", F.col("before") + F.col("id") - F.col("_spans.low"))
    others = [c for c in commands.columns if c != "seq"]
    once = placed.groupBy("seq", "id").agg(F.min("pos").alias("pos"), F.first(F.struct(*others)).alias("_c"))
    return once.select("seq", *[F.col(f"_c.{c}").alias(c) for c in others], "pos", "id").select(*commands.columns, "pos", "id")


def transition(events: DataFrame, commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """approve, reject, ignore, retry, edit and adopt: (events', outcome per command row).

    commands: seq, pos, id, action and, for edits, title and start_ts; they act in the order of (seq, pos). No
    command leads back to a state that another one could leave, except that an edit works from any state. So the
    first command the stored status allows takes effect, later edits add to it, and everything else is refused:
    minima and maxima per event tell it all, however many commands one event receives.
    """
    place = F.struct("seq", "pos")
    action, status = F.col("action"), F.col("status")
    target = F.coalesce(*[F.when(action == a, F.lit(t)) for a, t in TARGETS.items()], F.lit("approved"))
    edits = (action == "edit") & (F.col("new_title").isNotNull() | F.col("new_start").isNotNull())
    allowed = F.coalesce(
        F.when(action.isin(*TARGETS), status == "pending").when(action == "retry", status.isin(*lx.RETRYABLE_STATUSES))
        .when(action == "adopt", status.isin(*lx.FROZEN_STATUSES)).when(action == "edit", edits), F.lit(False))
    asked = commands.select("seq", "pos", "id", "action", F.col("title").alias("new_title"),
                            F.col("start_ts").alias("new_start"), place.alias("place"))
    seen = asked.join(events.select("id", "status"), "id", "left").withColumns({
        "target": target, "edits": edits & status.isNotNull(), "allowed": allowed & status.isNotNull()})
    effect = seen.where("allowed").groupBy("id").agg(
        F.min(F.struct("place", "action", "target")).alias("first"), F.min(F.when(F.col("edits"), F.col("place"))).alias(
            "first_edit"),
        F.max_by("new_title", F.when(F.col("edits") & F.col("new_title").isNotNull(), F.col("place"))).alias("new_title"),
        F.max_by("new_start", F.when(F.col("edits") & F.col("new_start").isNotNull(), F.col("place"))).alias("new_start"))
    change = effect.select(
        "id", F.col("first.action").alias("_a"), F.col("first_edit").isNotNull().alias("_edited"),
        F.when(F.col("first_edit").isNotNull(), F.lit("approved")).otherwise(F.col("first.target")).alias("_t"),
        "new_title", "new_start")
    judged = seen.drop("new_title", "new_start").join(effect.select("id", "first", "first_edit"), "id", "left")
    current = (F.when(F.col("first_edit") < F.col("place"), F.lit("approved"))
               .when(F.col("first.place") < F.col("place"), F.col("first.target")).otherwise(status))
    hash_id = F.concat(F.lit("#"), F.col("id").cast("string"))
    changed = F.coalesce(F.col("first.place") == F.col("place"), F.lit(False)) | F.col("edits")
    already = action.isin(*TARGETS) & (current == F.col("target"))
    refused = (F.when(action == "retry", F.concat(hash_id, F.lit(" 当前为 "), current, F.lit("，无需重试")))
               .when(action == "adopt", F.concat(hash_id, F.lit(" 当前为 "), current, F.lit("，仅冻结态可 adopt")))
               .when(action == "edit", F.lit("未提供任何要修改的字段"))
               .otherwise(F.concat(hash_id, F.lit(" 当前为 "), current, F.lit("，不允许 "), action)))
    outcomes = judged.select(
        "seq", "pos", "id", "action",
        F.when(status.isNull(), "not_found").when(changed, "changed").otherwise("skipped").alias("result"),
        F.when(status.isNull(), F.concat(hash_id, F.lit(" 不存在"))).when(changed, F.lit(None))
        .when(already, F.concat(hash_id, F.lit(" 已是 "), current)).otherwise(refused).alias("reason"))
    return _apply_changes(events, change, now), outcomes


def _apply_changes(events: DataFrame, change: DataFrame, now: Column) -> DataFrame:
    joined = events.join(change, "id", "left")
    act, hit = F.col("_a"), F.col("_a").isNotNull()
    edited = F.coalesce("_edited", F.lit(False))
    edits_title, edits_start = F.col("new_title").isNotNull(), F.col("new_start").isNotNull()
    adopt = act == "adopt"
    own = F.coalesce("field_provenance", F.expr("cast(map() as map<string,string>)"))

    def human(fields: Column) -> Column:
        # later marks replace earlier ones of the same field
        kept = F.map_filter(own, lambda k, _: ~F.array_contains(fields, k))
        return F.map_concat(kept, F.map_from_arrays(fields, F.transform(fields, lambda _: F.lit("human"))))

    marked = F.when(adopt, F.array(*[F.lit(f) for f in HUMAN_FIELDS])).otherwise(F.filter(
        F.array(F.when(edits_title, F.lit("title")), F.when(edits_start, F.lit("start_ts"))),
        lambda f: f.isNotNull()))
    new = {
        "status": F.coalesce("_t", "status"), "needs_attention": F.col("needs_attention") & ~hit,
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "title": F.when(edits_title, F.col("new_title")).otherwise(F.col("title")),
        "start_ts": F.when(edits_start, F.col("new_start")).otherwise(F.col("start_ts")),
        "manual_edited": F.coalesce("manual_edited", F.lit(False)) | edited,
        "field_provenance": F.when(edited | adopt, human(marked)).otherwise(F.col("field_provenance")),
        "push_attempts": F.when(act == "retry", 0).otherwise(F.col("push_attempts")),
        "snapshot_hash": F.when(adopt, F.coalesce("remote_norm_hash", "snapshot_hash")).otherwise(F.col("snapshot_hash")),
        "snapshot_payload": F.when(adopt, F.lit(None)).otherwise(F.col("snapshot_payload")),
        "managed_state": F.when(adopt, F.lit("adopted")).otherwise(F.col("managed_state")),
        "last_checked_at": F.when(adopt, now).otherwise(F.col("last_checked_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def command_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("action").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("result") == "changed").alias("changed"),
        F.count_if(F.col("result") == "skipped").alias("skipped"),
        F.count_if(F.col("result") == "not_found").alias("not_found"))


# --- the delayed release queue --------------------------------------------------------------------------------


def auto_pushable(threshold: float = lx.AUTO_PUSH_THRESHOLD) -> Column:
    """Whether an event may go out without a person: trusted source, has a start, no open question."""
    trusted = (F.when(F.col("source") == "ics", F.length("ics_uid") > 0)
               .when(F.col("source") == "rules", F.coalesce("confidence", F.lit(0.0)) > threshold))
    return F.coalesce(~F.col("needs_attention") & F.col("start_ts").isNotNull() & trusted, F.lit(False))


def schedule(events: DataFrame, pushes: DataFrame, now: Column, delay_minutes: int,
             threshold: float = lx.AUTO_PUSH_THRESHOLD) -> DataFrame:
    """Queue rows for pending events on the whitelist that are not queued yet."""
    queued = pushes.where("state = 'queued'").select(F.col("event_id").alias("id"))
    ready = events.where(auto_pushable(threshold) & (F.col("status") == "pending")).join(queued, "id", "left_anti")
    return ready.select(
        F.lit(None).cast("long").alias("id"), F.col("id").alias("event_id"),
        (now + F.make_dt_interval(mins=F.lit(delay_minutes))).alias("scheduled_for"), F.lit("queued").alias("state"),
        F.lit(None).cast("string").alias("run_id"), now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("dispatched_at"), F.lit(None).cast("string").alias("error"))


def push_window(pushes: DataFrame, events: DataFrame, now: Column, within_minutes: int = 60) -> DataFrame:
    """Queued pushes that can still be withdrawn: due before the horizon, the overdue ones included."""
    horizon = now + F.make_dt_interval(mins=F.lit(within_minutes))
    due = pushes.where((F.col("state") == "queued") & (F.col("scheduled_for") <= horizon)).select(
        F.col("id").alias("queue_id"), F.col("event_id").alias("id"), "scheduled_for")
    return due.join(events, "id").orderBy("scheduled_for", "queue_id")


def due_pushes(pushes: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Queued pushes whose time has come, the earliest first; all of them without a limit."""
    ready = pushes.where((F.col("state") == "queued") & (F.col("scheduled_for") <= now)).orderBy("scheduled_for", "id")
    return ready if limit is None else ready.limit(limit)


def dispatch(pushes: DataFrame, events: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """The queue after a release: due rows of approved events go out, the others are withdrawn with a reason."""
    due = pushes.where((F.col("state") == "queued") & (F.col("scheduled_for") <= now)) if limit is None else (
        due_pushes(pushes, now, limit))
    state = events.select(F.col("id").alias("event_id"), F.col("status").alias("_status"))
    decided = due.select("id", "event_id").join(state, "event_id", "left").select(
        "id", (F.coalesce("_status", F.lit("missing")) == "approved").alias("_ok"),
        F.coalesce("_status", F.lit("missing")).alias("_status"))
    joined = pushes.join(decided, "id", "left")
    why = F.concat(F.lit("事件状态为 "), F.col("_status"), F.lit("，跳过"))
    hit = F.col("_ok").isNotNull()
    new = {"state": F.when(F.col("_ok"), "dispatched").when(hit, "cancelled").otherwise(F.col("state")),
           "dispatched_at": F.when(hit, now).otherwise(F.col("dispatched_at")),
           "error": F.when(F.col("_ok"), F.lit(None)).when(hit, why).otherwise(F.col("error"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in pushes.columns])


def cancel_pushes(pushes: DataFrame, events: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Withdraw queued pushes named by queue id or else by event id: (pushes', events', outcome per key).

    A withdrawn event that was approved is pending again, so that nothing sends it without a new approval.
    """
    by_queue = pushes.select(F.col("id").alias("key"), F.col("id").alias("q1"), F.col("state").alias("s1"),
                             F.col("event_id").alias("e1"))
    by_event = pushes.where("state = 'queued'").groupBy(F.col("event_id").alias("key")).agg(
        F.min("id").alias("q2")).withColumn("e2", F.col("key"))
    found = keys.select(F.col("key").cast("long").alias("key")).distinct().join(by_queue, "key", "left").join(
        by_event, "key", "left").select(
        "key", F.coalesce("q1", "q2").alias("queue_id"), F.coalesce("e1", "e2").alias("event_id"),
        F.coalesce("s1", F.when(F.col("q2").isNotNull(), F.lit("queued"))).alias("state"))
    outcome = found.select("key", "queue_id", "event_id", F.when(F.col("queue_id").isNull(), "not_found").when(
        F.col("state") != "queued", "skipped").otherwise("changed").alias("result"))
    done = outcome.where("result = 'changed'")
    queue = pushes.join(done.select(F.col("queue_id").alias("id"), F.lit(True).alias("_c")).distinct(), "id", "left")
    queue = queue.withColumn("state", F.when(F.col("_c"), "cancelled").otherwise(F.col("state"))).select(*pushes.columns)
    back = events.join(done.select(F.col("event_id").alias("id"), F.lit(True).alias("_c")).distinct(), "id", "left")
    reverted = F.coalesce(F.col("_c"), F.lit(False)) & (F.col("status") == "approved")
    back = back.withColumns({"status": F.when(reverted, "pending").otherwise(F.col("status")),
                             "needs_attention": F.col("needs_attention") & ~reverted}).select(*events.columns)
    return queue, back, outcome


def withdraw_approved(pushes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after commands (the outcomes of ``transition``): what a person has just approved does not wait."""
    return cancel_queued_of(pushes, outcomes.where("action = 'approve' AND result = 'changed'"))


def cancel_queued_of(pushes: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Queued pushes of approved events are withdrawn: a person's approval acts at once."""
    hit = event_ids.select(F.col("id").alias("event_id")).distinct().withColumn("_c", F.lit(True))
    return pushes.join(hit, "event_id", "left").withColumn("state", F.when(
        F.col("_c") & (F.col("state") == "queued"), "cancelled").otherwise(F.col("state"))).select(*pushes.columns)
