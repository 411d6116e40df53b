"""Counters and top lists over the state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.headers import is_seen
from mailspark.session import by_key, checkpointed


def count_by(df: DataFrame, key: str, section: str) -> DataFrame:
    """(section, key, n) rows of one grouped count."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(section).alias("section"), "key", "n")


def totals(df: DataFrame, section: str, **counts: Column) -> DataFrame:
    """(section, key, n) rows of several conditional counts taken in one pass."""
    row = df.agg(*[c.alias(k) for k, c in counts.items()])
    return row.select(F.lit(section).alias("section"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("n")) for k in counts])).alias("r")).select(
        "section", "r.*")


def sections(df: DataFrame, by: dict[str, tuple[str, str | None]] | None = None, **totals: dict[str, Column]) -> DataFrame:
    """(section, key, n) rows of several grouped counts and several conditional counts, taken in one scan.

    by: section to (column, name of its nulls); totals: section to named aggregates over all rows. Each grouping is
    one set of GROUPING SETS, so a row is read once and each task sends one row for each group. An empty table has
    its totals, all 0.
    """
    by = by or {}
    keyed = df.select("*", *[(F.col(c) if name is None else F.coalesce(F.col(c), F.lit(name))).cast("string").alias(f"_{section}")
                             for section, (c, name) in by.items()])
    keys = [f"_{section}" for section in by]
    named = [(section, k, c) for section, counts in totals.items() for k, c in counts.items()]
    grouped = keyed.groupingSets([*([k] for k in keys), []], *keys) if keys else keyed.groupBy()
    counted = grouped.agg(*[F.grouping(k).alias(f"_of{k}") for k in keys], F.count(F.lit(1)).alias("_n"),
                          *[c.cast("long").alias(f"_t{i}") for i, (_, _, c) in enumerate(named)])
    entry = lambda section, key, n: F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))
    whole = F.array(*[entry(section, F.lit(k), F.col(f"_t{i}")) for i, (section, k, _) in enumerate(named)])
    rows = F.lit(None) if not named else whole
    for section in reversed(by):
        rows = F.when(F.col(f"_of_{section}") == 0, F.array(entry(section, F.col(f"_{section}"), F.col("_n")))).otherwise(rows)
    found = counted.select(F.explode(rows).alias("r")).select("r.*")
    if not (keys and named):
        return found
    none = F.array(*[entry(section, F.lit(k), F.lit(0).cast("long")) for section, k, _ in named])
    zeros = df.sparkSession.range(1).select(F.explode(none).alias("r")).select("r.*")
    return found.unionByName(zeros).groupBy("section", "key").agg(F.sum("n").alias("n"))


def snapshot(messages: DataFrame, processed: DataFrame, events: DataFrame, pushes: DataFrame, threads: DataFrame,
             senders: DataFrame, runs: DataFrame) -> DataFrame:
    """Every figure of the statistics report as (section, key, n), in one scan of each table."""
    every = F.count(F.lit(1))
    parts = [
        sections(messages, {"messages_by_extract_status": ("extract_status", None)}, messages={
            "total": every, "with_ics": F.count_if("has_ics"), "with_unsubscribe": F.count_if("has_unsubscribe")}),
        sections(senders, senders={"total": every}),
        sections(processed, {"sync_by_status": ("status", None)}),
        sections(events, {"events_by_status": ("status", None), "events_by_source": ("source", None)}, events={
            "needs_attention": F.count_if("needs_attention"), "pending_review": F.count_if(F.col("status") == "pending"),
            "auto_pushable": F.count_if(F.col("status") == "approved")}),
        sections(pushes, pushes={"pending_window": F.count_if(F.col("state") == "queued")}),
        sections(threads, {"threads_by_strength": ("link_strength", "unknown")}, threads={"total": every}),
        sections(runs, runs={"total": every, "failed": F.count_if(~F.col("ok"))}),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_senders(senders: DataFrame, limit: int = 20) -> DataFrame:
    return senders.orderBy(F.desc("total"), "account", "addr").limit(limit)


def noise_clusters(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Bulk senders by list id or domain, with how much is unread; anyone the user answered is left out."""
    domain = F.regexp_extract("from_addr", "@(.+)$", 1)
    cluster = F.coalesce(F.when(F.length("list_id") > 0, F.col("list_id")), domain)
    known = contacts.where("replied_count > 0").select(F.lower("addr").alias("from_addr")).distinct()
    return (messages.withColumn("from_addr", F.lower("from_addr")).join(known, "from_addr", "left_anti")
            .groupBy(cluster.alias("cluster")).agg(
                F.count(F.lit(1)).alias("messages"), F.count_if(~is_seen(F.col("flags"))).alias("unread"),
                F.count_distinct("from_addr").alias("senders"),
                F.count_if("has_unsubscribe").alias("with_unsubscribe"), F.max("received_at").alias("last_seen_at")))


MAILBOX_FILTERS = ("all", "unread", "with_events", "no_events", "extract_failed", "pending_extract", "marked_by_us")


def mailbox(messages: DataFrame, events: DataFrame, which: str = "all", search: str | None = None,
            limit: int | None = None) -> DataFrame:
    """The mail list: one of seven filters, an optional search, newest first, with each row's event count."""
    rows = messages
    owners = events.select(F.col("message_id").alias("id"))
    if which == "unread":
        rows = rows.where(~is_seen(F.col("flags")))
    elif which == "with_events":
        rows = rows.join(owners, "id", "left_semi")
    elif which == "no_events":
        rows = rows.join(owners, "id", "left_anti")
    elif which == "extract_failed":
        rows = rows.where("extract_status = 'failed'")
    elif which == "pending_extract":
        rows = rows.where("extract_status = 'pending'")
    elif which == "marked_by_us":
        rows = rows.where("marked_read_at is not null")
    if search:
        word = F.lower(F.lit(search))
        rows = rows.where(F.contains(F.lower("subject"), word) | F.contains(F.lower("from_addr"), word))
    if limit is not None:
        rows = rows.orderBy(F.desc_nulls_last("received_at"), F.desc("id")).limit(limit)
    if limit is not None:
        events = events.join(rows.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    counts = events.groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("event_count"))
    return rows.join(counts, "id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def message_detail(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Selected messages with their events, one row per event; a message without events keeps one row."""
    listed = events.select(F.col("message_id").alias("id"), F.col("id").alias("event_id"), "start_ts", "title", "status",
                           "source")
    return messages.join(listed, "id", "left")


def extract_stats(verdicts: DataFrame, candidates: DataFrame, merged: DataFrame | None = None,
                  lost: DataFrame | None = None, before: DataFrame | None = None, after: DataFrame | None = None,
                  answered: DataFrame | None = None) -> DataFrame:
    """(section, key, n): how far each message got, what came out of it, and what was written.

    merged: events with their ``outcome``. lost: events no longer produced, with ``removable``. before and after:
    messages around the run. answered: message_id, ok of the messages that a model was asked for.
    """
    # each part below reads them again: keep the thin columns, not the passes over the texts
    verdicts = checkpointed(verdicts.select("message_id", "extract", "call_llm"))
    candidates = checkpointed(candidates.select("message_id", "source", "requires_review"))
    parts = []
    if merged is not None:
        parts.append(totals(merged, "extract", **{f"events_{k}": F.count_if(F.col("outcome") == k) for k in (
            "inserted", "updated", "protected")}))
    if lost is not None:
        parts.append(totals(lost, "extract", events_removed=F.count_if("removable"), events_orphaned=F.count_if(~F.col("removable"))))
    if before is not None and after is not None:
        was = before.select("id", F.col("extract_status").alias("was"), F.col("extract_attempts").alias("tried"))
        moved = after.select("id", "extract_status", "extract_attempts").join(was, "id")
        left = F.col("extract_status") == "failed"
        parts.append(totals(moved, "extract", failed=F.count_if(F.col("extract_attempts") > F.col("tried")),
                            attempts_exhausted=F.count_if(left & (F.col("was") != "failed")),
                            zombies_reclaimed=F.count_if((F.col("was") == "running") & (F.col("extract_status") != "running"))))
    wanted = verdicts.where("extract AND call_llm").select("message_id")
    settled = candidates.where("source IN ('ics', 'rules') AND NOT requires_review").select("message_id").distinct()
    asked = wanted.join(by_key(settled), "message_id", "left_anti")
    if answered is not None:
        told = asked.join(answered.select("message_id", "ok"), "message_id", "left")
        parts.append(totals(told, "extract", llm_called=F.count("ok"), llm_ok=F.count_if("ok"),
                            llm_failed=F.count_if(~F.col("ok")), llm_skipped=F.count_if(F.col("ok").isNull())))
    else:
        parts.append(totals(asked, "extract", llm_called=F.lit(0).cast("long"), llm_skipped=F.count(F.lit(1))))
    return reduce(DataFrame.unionByName, [
        *parts,
        totals(verdicts, "messages", considered=F.count(F.lit(1)), skipped_by_prefilter=F.count_if(~F.col("extract")),
               call_llm=F.count_if("call_llm")),
        totals(candidates, "candidates", total=F.count(F.lit(1)), with_candidates=F.count_distinct("message_id"),
               requires_review=F.count_if("requires_review"),
               auto_pushable=F.count_if(~F.col("requires_review"))),
        count_by(candidates, "source", "by_source")])


def sync_stats(folders: DataFrame) -> DataFrame:
    """Sums over the folders of a run, and whether any of them failed."""
    sums = [F.sum(c).alias(c) for c in ("scanned", "inserted", "duplicated", "reactivated", "skipped_known", "moved",
                                        "fetch_failed") if c in folders.columns]
    return folders.agg(*sums, F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("has_errors"))


def first_errors(errors: DataFrame, order: str, text: str, limit: int = 10) -> DataFrame:
    """The first few error texts as one list; cut before they are brought together."""
    return errors.orderBy(order).limit(limit).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))),
                                                              lambda e: e[text]).alias("errors"))


def worst_exit(stages: DataFrame) -> DataFrame:
    """The exit code of a run: the worst of its stages; a missed lock is a plain failure."""
    return stages.agg(F.coalesce(F.max(F.when(F.col("lock_missed"), 1).otherwise(F.col("exit_code"))), F.lit(0)).alias(
        "exit_code"))


def _label(code: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def status_label(code: Column) -> Column:
    return _label(code, lx.EVENT_STATUS_LABELS)


def source_label(code: Column) -> Column:
    return _label(code, lx.SOURCE_LABELS)


def extract_status_label(code: Column) -> Column:
    return _label(code, lx.EXTRACT_STATUS_LABELS)
