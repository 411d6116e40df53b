"""Which messages are dealt with and may be marked as read, and which marks can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.headers import is_seen
from mailspark.operators.prefilter import actionable_signal

BLOCKING = ("pending", "uncertain", "push_failed")


def guard_epochs(folders: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Live folders with the reason they must be left alone, null when their uids can be trusted."""
    known = sync_state.select("account", "folder", F.col("uid_validity").alias("_v"))
    changed = F.concat(F.lit("UIDVALIDITY 已变化（库中 "), F.col("_v").cast("string"), F.lit(" ≠ 服务端 "),
                       F.col("uid_validity").cast("string"), F.lit("）"))
    return folders.join(known, ["account", "folder"], "left").withColumn(
        "skipped_reason", F.when(F.col("_v").isNull(), F.lit("尚无同步记录")).when(
            F.col("_v") != F.col("uid_validity"), changed)).drop("_v")


def select_candidates(messages: DataFrame, events: DataFrame, policy: str = "resolved",
                      limit: int | None = None) -> DataFrame:
    """Messages to mark, each with its reason. ``resolved`` also leaves alone what reads like a request."""
    done = messages.where(
        "is_canonical and not stale and not folder_moved and extract_status = 'done' and marked_read_at is null")
    if policy == "off":
        return done.limit(0).withColumn("reason", F.lit(""))
    if policy == "resolved":
        blocked = events.where(F.col("status").isin(*BLOCKING)).select(F.col("message_id").alias("id"))
        done = done.join(blocked, "id", "left_anti")
    if limit:
        done = done.orderBy("uid").limit(limit)
    if policy == "processed":
        counted, why = done, F.lit("抽取已完成")
    else:
        totals = events.groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        counted = done.join(totals, "id", "left")
        why = F.when(F.col("_n").isNull(), F.lit("无事件（无需处理）")).otherwise(
            F.concat(F.col("_n").cast("string"), F.lit(" 个事件均已处理完毕")))
    counted = counted.withColumn("already_seen", is_seen(F.col("flags")))
    if policy == "resolved":
        signal = actionable_signal(F.col("subject"), F.col("from_addr"))
        counted = counted.where(F.col("already_seen") | signal.isNull())
    return counted.withColumn("reason", F.when(F.col("already_seen"), F.lit("already-seen")).otherwise(why)).select(
        "id", "account", "folder", "uid", F.coalesce(F.when(F.length("subject") > 0, F.col("subject")),
                                                     F.lit(lx.NO_SUBJECT)).alias("subject"),
        "from_addr", "received_at", "extract_status", "already_seen", "reason")


def undo_candidates(messages: DataFrame) -> DataFrame:
    return messages.where("is_canonical and marked_read_at is not null").select(
        "id", "account", "folder", "uid", "subject", F.lit("本程序标记过").alias("reason"))


def mark_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("account", "folder").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("already_seen").alias("already_seen"),
        F.count_if(~F.col("already_seen")).alias("to_write"))
