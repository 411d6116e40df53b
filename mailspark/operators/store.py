"""Keyed merges: every state change is a pure function (table, changes) -> new table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx

Rule = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def larger(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def added(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """Insert or update on a unique key, one merge rule per column (default: the change wins unless null).

    ``changes`` must hold one row per key; use ``last_write`` to reduce a log to that.
    """
    rules = rules or {}
    old, new = table.alias("o"), changes.alias("n")
    condition = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = old.join(new, condition, "full_outer")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in changes.columns:
            out.append(rules.get(c, newest)(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def last_write(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key; combined before the shuffle, so a hot key costs one row per task."""
    payload = [c for c in log.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload])
    return log.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_r")).select(*keys, "_r.*")


_FREE = ("start_ts", "end_ts", "all_day", "tz", "location", "organizer", "confidence", "ics_uid", "ics_sequence",
         "ics_recurrence_id", "ics_rrule")


def upsert_candidates(events: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Candidates into the events table on (message_id, fingerprint), which stays unique.

    Several candidates of one key act one after the other, in the order of (ord, start_ts, title, confidence) as far
    as there are such columns: the last one's values stay, the source of a new event is the first one's.
    A stored event that a person has ruled on (or edited) only takes a new title and evidence; a free one takes
    everything and is pending again; an unknown one is inserted with its review reason in front of the evidence.
    ``outcome`` tells inserted, updated, protected and kept rows apart. New rows have a null id: the caller
    numbers them when it writes (see ``number_new_rows``).
    """
    fresh = candidates.select("message_id", "fingerprint", F.struct(
        *[F.col(c) for c in candidates.columns if c not in ("message_id", "fingerprint")]).alias("c"))
    order = F.struct(*[F.col(f"c.{c}") for c in ("ord", "start_ts", "title", "confidence", "evidence") if c in candidates.columns])
    fresh = fresh.groupBy("message_id", "fingerprint").agg(
        F.max_by("c", order).alias("c"), F.min_by("c.source", order).alias("source"))
    joined = events.alias("e").join(fresh.alias("n"), ["message_id", "fingerprint"], "full_outer")
    stored, arrived = F.col("e.status").isNotNull(), F.col("n.c").isNotNull()
    protected = F.coalesce(F.col("e.status").isin(*lx.PROTECTED_STATUSES) | F.coalesce("e.manual_edited", F.lit(False)),
                           F.lit(False))
    outcome = (F.when(~stored, "inserted").when(~arrived, "kept").when(protected, "protected").otherwise("updated"))
    first_evidence = F.when(
        F.col("c.requires_review") & (F.coalesce("c.review_reason", F.lit("")) != ""),
        F.trim(F.concat(F.lit(lx.REVIEW_PREFIX), F.col("c.review_reason"), F.lit("] "),
                        F.coalesce("c.evidence", F.lit(""))))).otherwise(F.col("c.evidence"))
    replaces = F.col("outcome").isin("inserted", "updated")
    changed = F.col("outcome") != "kept"

    def pick(condition: Column, new: Column, column: str) -> Column:
        return F.when(condition, new).otherwise(F.col(f"e.{column}")).alias(column)

    cols = []
    for c in events.columns:
        if c in ("message_id", "fingerprint"):
            cols.append(F.col(c))
        elif c == "title":
            cols.append(pick(changed, F.col("c.title"), c))
        elif c == "evidence":
            cols.append(F.when(F.col("outcome") == "inserted", first_evidence)
                        .when(changed, F.col("c.evidence")).otherwise(F.col("e.evidence")).alias(c))
        elif c == "status":
            cols.append(pick(replaces, F.lit("pending"), c))
        elif c == "needs_attention":
            cols.append(pick(replaces, F.col("c.requires_review"), c))
        elif c == "source":
            cols.append(pick(F.col("outcome") == "inserted", F.col("n.source"), c))
        elif c in _FREE and c in candidates.columns:
            cols.append(pick(replaces, F.col(f"c.{c}"), c))
        elif c == "created_at":
            cols.append(F.coalesce("e.created_at", now).alias(c))
        elif c == "updated_at":
            cols.append(pick(changed, now, c))
        elif c == "manual_edited":
            cols.append(F.coalesce("e.manual_edited", F.lit(False)).alias(c))
        else:
            cols.append(F.col(f"e.{c}").alias(c))
    return joined.withColumn("outcome", outcome).select(*cols, "outcome")


def number_new_rows(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Fill null ids above the present maximum with ids that are unique without a global sort."""
    top = df.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    return df.withColumn(id_column, F.coalesce(F.col(id_column), top + 1 + F.monotonically_increasing_id()))


def orphans(events: DataFrame, produced: DataFrame, pushes: DataFrame, reprocessed: DataFrame,
            llm_usable: bool = True) -> DataFrame:
    """Stored events of re-read messages whose fingerprint is no longer produced, each with ``removable``.

    Only what no person and no calendar has touched may go; without a model at hand its earlier results stay.
    """
    gone = (events.join(reprocessed.select("message_id").distinct(), "message_id", "left_semi")
            .join(produced.select("message_id", "fingerprint"), ["message_id", "fingerprint"], "left_anti"))
    sent = pushes.where("state = 'dispatched'").select(F.col("event_id").alias("id")).distinct().withColumn(
        "_sent", F.lit(True))
    removable = ((F.col("status") == "pending") & ~F.coalesce("manual_edited", F.lit(False))
                 & (F.coalesce(F.length("gcal_event_id"), F.lit(0)) == 0) & F.col("_sent").isNull())
    if not llm_usable:
        removable = removable & (F.col("source") != "llm")
    return gone.join(sent, "id", "left").withColumn("removable", removable).drop("_sent")


def remove_orphans(events: DataFrame, pushes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and pushes without the removable orphans; their queued pushes go first."""
    doomed = found.where("removable").select("id")
    return (events.join(doomed, "id", "left_anti"),
            pushes.join(doomed.withColumnRenamed("id", "event_id"), "event_id", "left_anti").select(*pushes.columns))


def supersede(events: DataFrame) -> DataFrame:
    """Mark calendar entries that a higher sequence of the same entry replaces; final states stay as they are."""
    key = ["ics_uid", F.coalesce("ics_recurrence_id", F.lit("")).alias("_rec"),
           F.lower(F.coalesce("organizer", F.lit(""))).alias("_org")]
    keyed = events.select("*", *key[1:])
    top = keyed.where("ics_uid is not null").groupBy("ics_uid", "_rec", "_org").agg(
        F.max(F.coalesce("ics_sequence", F.lit(0))).alias("_top"))
    older = F.coalesce(F.coalesce("ics_sequence", F.lit(0)) < F.col("_top"), F.lit(False))
    final = F.col("status").isin(*lx.TERMINAL_STATUSES)
    return (keyed.join(top, ["ics_uid", "_rec", "_org"], "left")
            .withColumn("status", F.when(older & ~final, F.lit("superseded")).otherwise(F.col("status")))
            .select(*events.columns))
