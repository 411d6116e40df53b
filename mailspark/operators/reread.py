"""Compensating re-read: the last days of due folders once more, for messages below the cursor that were lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark.operators.ingest import FOLDER

EPOCH = [*FOLDER, "uid_validity"]
#: Uids of one block: what one row of the known-uid filter covers.
BLOCK = 4096


def known_spans(messages: DataFrame) -> DataFrame:
    """The stored uids of every folder epoch as sorted runs: one row for each block of uids, with the runs' ends.

    A folder that was read without gaps has one run a block, whatever it holds. Blocks spread a large folder over tasks.
    """
    low = F.array_sort(F.collect_set((F.col("uid") % BLOCK).cast("int")))
    blocks = messages.groupBy(*EPOCH, F.floor(F.col("uid") / BLOCK).alias("block")).agg(low.alias("u"))
    first = F.filter("u", lambda x, i: (i == 0) | (F.get(F.col("u"), i - 1) < x - 1))
    last = F.filter("u", lambda x, i: (i == F.size("u") - 1) | (F.get(F.col("u"), i + 1) > x + 1))
    return blocks.select(*EPOCH, "block", F.arrays_zip(first.alias("first"), last.alias("last")).alias("spans"))


def lost_messages(raw: DataFrame, messages: DataFrame, due: DataFrame, since_day: Column | str, day: str = "received_day") -> DataFrame:
    """Raw rows of due folders (account, folder, uid_validity; one row each) from ``since_day`` on that are not stored.

    ``raw`` is partitioned by ``day``, so older days are not read. The stored table is read for its uids only, in the
    due folders only; what meets the raw rows is known_spans(). Null uids are no messages. Raw rows that repeat a uid
    come once.
    """
    recent = raw.where((F.col(day) >= since_day) & F.col("uid").isNotNull())
    folders = due.select(*EPOCH).distinct()
    spans = known_spans(messages.select(*EPOCH, "uid").join(folders, EPOCH, "left_semi"))
    placed = recent.join(folders, EPOCH, "left_semi").withColumn("block", F.floor(F.col("uid") / BLOCK))
    low = F.col("uid") % BLOCK
    held = F.exists("spans", lambda s: (s["first"] <= low) & (low <= s["last"]))
    missing = placed.join(spans, [*EPOCH, "block"], "left").where(~F.coalesce(held, F.lit(False)))
    return missing.drop("block", "spans").dropDuplicates([*EPOCH, "uid"])


def reread_done(sync_state: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """The state after the re-read: due folders start to count anew; cursors stay where they are."""
    marks = due.select(*FOLDER).distinct().withColumn("_done", F.lit(True))
    done = F.col("_done").isNotNull()
    return sync_state.join(marks, FOLDER, "left").withColumns({
        "syncs_since_full": F.when(done, 0).otherwise(F.col("syncs_since_full")).cast("int"),
        "last_full_sync_at": F.when(done, now).otherwise(F.col("last_full_sync_at"))}).drop("_done")
