"""The daily digest as rows of lines, one set per local date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions import payload as pl
from mailspark.functions.common import let, local_day, local_time, nonempty
from mailspark.functions.text import sanitize_text
from mailspark.operators.rules import DEFAULT_ZONE

SECTIONS = ("calendar", "window", "pending", "attention", "messages", "threads", "system", "notes")


def when_text(ts: Column, all_day: Column, tz: str = DEFAULT_ZONE) -> Column:
    """Local display of an event time; an all-day one shows no clock."""
    local = local_time(ts, tz)
    return (F.when(ts.isNull(), "（无时间）").when(all_day, F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" 全天")))
            .otherwise(F.date_format(local, "yyyy-MM-dd HH:mm")))


def relative_text(ts: Column, now: Column, tz: str = DEFAULT_ZONE) -> Column:
    """How long ago: just now, minutes, hours, days, else the date. A future time shows its clock."""
    def text(seconds: Column) -> Column:
        def ago(unit: int, name: str) -> Column:
            return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name}前"))

        return (F.when(seconds.isNull(), "—").when(seconds < 0, F.date_format(local_time(ts, tz), "MM-dd HH:mm"))
                .when(seconds < 60, "刚刚").when(seconds < 3600, ago(60, "分钟")).when(seconds < 86400, ago(3600, "小时"))
                .when(seconds < 7 * 86400, ago(86400, "天")).otherwise(F.date_format(local_time(ts, tz), "yyyy-MM-dd")))

    return let(F.unix_timestamp(now) - F.unix_timestamp(ts), text)


def split_days(entries: DataFrame, now: Column, tz: str = DEFAULT_ZONE, days: int = 7) -> DataFrame:
    """(bucket, day, when, summary) of entries today and in the next days. entries: start_ts, all_day, summary."""
    today = local_day(now, tz)
    day = local_day(F.col("start_ts"), tz)
    clock = F.when(F.col("all_day"), "全天").otherwise(F.date_format(local_time(F.col("start_ts"), tz), "HH:mm"))
    bucket = F.when(day == today, "today").when((day > today) & (day <= F.date_add(today, days)), "upcoming")
    dated = F.concat(F.date_format(day, "MM-dd "), clock)
    return entries.withColumns({"bucket": bucket, "day": day}).where(F.col("bucket").isNotNull()).select(
        "bucket", F.col("day").cast("string").alias("day"),
        F.when(F.col("bucket") == "today", clock).otherwise(dated).alias("when"),
        sanitize_text(F.coalesce(nonempty(F.col("summary")), F.lit(lx.NO_TITLE)), 60).alias("summary"))


def calendar_entries(payloads: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """Remote payloads as digest entries; cancelled ones and those without a readable start are left out."""
    p = F.col("p")
    day = F.to_utc_timestamp(F.try_to_timestamp(F.substring(p["start"]["date"], 1, 10), F.lit("yyyy-MM-dd")), tz)
    return payloads.withColumn("p", pl.parse_payload(F.col("payload"))).where(
        F.coalesce(p["status"], F.lit("")) != "cancelled").select(
        F.coalesce(day, F.try_to_timestamp(p["start"]["dateTime"])).alias("start_ts"),
        (F.length(p["start"]["date"]) > 0).alias("_d"), p["summary"].alias("summary")).select(
        "start_ts", F.coalesce("_d", F.lit(False)).alias("all_day"), "summary").where("start_ts is not null")


def system_notes(snapshot: DataFrame) -> DataFrame:
    """Texts for the figures of a statistics snapshot that a reader should know about."""
    def note(section: str, key: str, before: str, after: str) -> Column:
        hit = (F.col("section") == section) & (F.col("key") == key) & (F.col("n") > 0)
        return F.when(hit, F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)))

    texts = F.coalesce(
        note("sync_by_status", "fetch_failed", "有 ", " 封邮件的抓取曾失败（见同步台账）。"),
        note("runs", "failed", "历史运行中有 ", " 次未成功。"),
        note("messages_by_extract_status", "running", "有 ", " 封邮件停留在「抽取中」状态。"),
        note("extract", "llm_skipped", "", " 封邮件本可交给 LLM 抽取，但被跳过；这些邮件只做了规则与 ICS 抽取。"),
        note("extract", "attempts_exhausted", "", " 封邮件已达抽取尝试上限，转为终态不再重试。"),
        note("extract", "events_protected", "", " 个事件因已被人工审批而未被抽取结果覆盖。"),
        note("threads_by_strength", "weak", "有 ", " 个线程是**主题弱关联**。这类线程不作为事实依据。"))
    return snapshot.select(texts.alias("note")).where("note is not null")


def _lines(df: DataFrame, section: str, line: Column, *order: Column, limit: int) -> DataFrame:
    """The first lines of one section with their position; cut in Spark before they are numbered."""
    top = df.select(line.alias("line"), F.struct(*order).alias("key")).orderBy("key").limit(limit)
    listed = top.agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("rows"))
    return listed.select(F.lit(section).alias("section"), F.posexplode(F.transform("rows", lambda r: r["line"])).alias(
        "ord", "line"))


def digest_lines(now: Column, snapshot: DataFrame, events: DataFrame, window: DataFrame, messages: DataFrame,
                 longest: DataFrame, entries: DataFrame | None = None, tz: str = DEFAULT_ZONE,
                 max_items: int = 25) -> DataFrame:
    """(digest_date, section, ord, line) of one day's digest. Every list is a top list, so each stays short."""
    def event_line(prefix: str = "") -> Column:
        return F.concat(F.lit("- `#"), F.col("id").cast("string"), F.lit("` "), F.lit(prefix),
                        when_text(F.col("start_ts"), F.col("all_day"), tz), F.lit(" · "), sanitize_text(F.col("title"), 60))

    soon = (F.coalesce(F.unix_timestamp("start_ts"), F.lit(-(1 << 62))), F.col("id"))
    parts = [
        _lines(window, "window", event_line(), F.unix_timestamp("scheduled_for"), F.col("queue_id"), limit=max_items),
        _lines(events.where("status = 'pending'"), "pending", event_line(), *soon, limit=max_items),
        _lines(events.where(F.col("status").isin(*lx.FROZEN_STATUSES, "push_failed", "uncertain")), "attention",
               F.concat(F.lit("["), F.col("status"), F.lit("] "), event_line()),
               F.when(F.col("status").isin(*lx.FROZEN_STATUSES), 0).otherwise(1), *soon, limit=2 * max_items),
        _lines(messages.where("is_canonical and not stale"), "messages", F.concat(
            F.lit("- "), when_text(F.col("received_at"), F.lit(False), tz), F.lit(" · "),
            sanitize_text(F.coalesce(nonempty(F.col("subject")), F.lit(lx.NO_SUBJECT)), 60),
            F.when(F.col("has_ics"), " 📅").otherwise(""), F.lit(" — "),
            sanitize_text(F.coalesce("from_addr", F.lit("")), 30)),
            -F.coalesce(F.unix_timestamp("received_at"), F.lit(-(1 << 62))), -F.col("id"), limit=15),
        _lines(longest, "threads", F.concat(
            F.lit("- "), F.col("n").cast("string"), F.lit(" 封 · "),
            sanitize_text(F.coalesce(nonempty(F.col("subject_norm")), F.lit(lx.NO_SUBJECT)), 55),
            F.when(F.coalesce("link_strength", F.lit("")) == "strong", "").otherwise(" ⚠️弱关联")),
            -F.col("n"), -F.coalesce(F.unix_timestamp("last_message_at"), F.lit(-(1 << 62))), F.col("id"), limit=8),
        _lines(snapshot, "system", F.concat(F.lit("- "), F.col("section"), F.lit(" "), F.col("key"), F.lit("："),
                                            F.col("n").cast("string")), F.col("section"), F.col("key"), limit=200),
        _lines(system_notes(snapshot), "notes", F.concat(F.lit("> ⚠️ "), F.col("note")), F.col("note"), limit=20),
    ]
    if entries is not None:
        days = split_days(entries, now, tz)
        shown = F.concat(F.lit("- "), F.col("when"), F.lit(" · "), F.col("summary"))
        parts.append(_lines(days.where("bucket = 'today'"), "today", shown, F.col("when"), F.col("summary"), limit=250))
        parts.append(_lines(days.where("bucket = 'upcoming'"), "upcoming", shown, F.col("day"), F.col("when"),
                            F.col("summary"), limit=10))
    lines = reduce(DataFrame.unionByName, parts)
    return lines.select(local_day(now, tz).cast("string").alias("digest_date"), "section",
                        F.col("ord").cast("long").alias("ord"), "line")


def digest_document(lines: DataFrame, now: Column, events: DataFrame, tz: str = DEFAULT_ZONE,
                    max_items: int = 25) -> DataFrame:
    """(report_date, rank, key, ord, line) of the digest as Markdown: ``lines`` of digest_lines with title, headings,
    and what stands in place of an empty list. ``events`` gives the whole number of those that wait for review."""
    spark = lines.sparkSession
    ranks = {section: k for k, section in enumerate(dict.fromkeys(row[0] for row in lx.DIGEST_FRAME), 1)}
    frame = spark.createDataFrame(
        [(section, ranks[section], shown, "0" if place == "before" else "2", k, text)
         for k, (section, shown, place, text) in enumerate(lx.DIGEST_FRAME)],
        "section string, rank int, shown string, key string, ord long, line string")
    filled = lines.select("section").distinct().withColumn("_filled", F.lit(True))
    texts = frame.join(filled, "section", "left").where(
        (F.col("shown") == "always") | (F.col("shown") == F.when(F.col("_filled"), "filled").otherwise("empty")))
    waiting = F.count_if(F.col("status") == "pending")
    counted = events.agg(waiting.alias("n")).where("n > 0").select(
        F.lit(ranks["pending"]).alias("rank"), F.lit("1").alias("key"), F.posexplode(F.array(F.concat(
            F.lit("共 "), F.col("n").cast("string"), F.lit(f" 条（最多列 {max_items} 条）")), F.lit(""))).alias("p", "line"))
    local = local_time(now, tz)
    title = spark.range(1).select(F.lit(0).alias("rank"), F.lit("0").alias("key"), F.posexplode(F.array(
        F.concat(F.lit("# 邮件摘要 · "), F.date_format(local, "yyyy-MM-dd")), F.lit(""),
        F.concat(F.lit("> 生成于 "), F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(f" {tz}")), F.lit(""))).alias("p", "line"))
    placed = F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])
    body = lines.select(placed[F.col("section")].alias("rank"), F.lit("1").alias("key"), "ord", "line")
    whole = (texts.select("rank", "key", "ord", "line").unionByName(body)
             .unionByName(counted.select("rank", "key", (F.col("p") - 2).cast("long").alias("ord"), "line"))
             .unionByName(title.select("rank", "key", F.col("p").cast("long").alias("ord"), "line")))
    return whole.select(local_day(now, tz).cast("string").alias("report_date"), "rank", "key", "ord", "line")
