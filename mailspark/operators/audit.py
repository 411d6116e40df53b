"""A second look at recent extraction: what today's rules would find, what the store lacks, what looks missed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import fold_spaces, local_time
from mailspark.functions.fingerprint import overlap, title_tokens
from mailspark.functions.text import has_date_shape, has_time_shape, head_excerpt
from mailspark.operators.candidates import extract
from mailspark.operators.rules import DEFAULT_ZONE
from mailspark.session import by_key, checkpointed

NONE, MAYBE, LIKELY = 0, 1, 2


def window_messages(messages: DataFrame, now: Column, hours: int = 24, limit: int | None = None) -> DataFrame:
    """Canonical messages received or fetched inside the window: late arrivals count as much as new ones."""
    start = now - F.make_dt_interval(hours=F.lit(hours))
    inside = F.col("received_at").between(start, now) | F.col("fetched_at").between(start, now)
    rows = messages.where(F.col("is_canonical") & inside)
    return rows if limit is None else rows.orderBy(F.desc_nulls_last("received_at"), F.desc("id")).limit(limit)


def missing_candidates(candidates: DataFrame, events: DataFrame, llm_called: bool = False,
                       threshold: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
    """Deterministic candidates without an equivalent stored event: same start and similar title, or both all-day
    on one date. Messages whose stored events came from a model are skipped while no model runs.

    Both tests are equi-joins (message and start, message and date) with a residual, so no message pairs all of
    its candidates with all of its events.
    """
    mine = candidates.where("source <> 'llm'")
    if not llm_called:
        modelled = events.where("source = 'llm'").select("message_id").distinct()
        mine = mine.join(by_key(modelled), "message_id", "left_anti")
    mine = mine.withColumns({"_toks": title_tokens(F.col("title")), "_date": F.to_date("start_ts")})
    stored = events.where("source <> 'llm' and start_ts is not null").select(
        "message_id", "start_ts", F.to_date("start_ts").alias("_date"), F.coalesce("all_day", F.lit(False)).alias("s_all_day"),
        title_tokens(F.col("title")).alias("s_toks"))
    timed = stored.select("message_id", "start_ts", "s_all_day", "s_toks").alias("s")
    c = mine.alias("c")
    left = c.join(by_key(timed), (F.col("c.message_id") == F.col("s.message_id")) & (F.col("c.start_ts") == F.col("s.start_ts"))
                  & ~(F.col("c.all_day") & F.col("s.s_all_day"))
                  & (overlap(F.col("c._toks"), F.col("s.s_toks")) >= threshold), "left_anti")
    days = stored.where("s_all_day").select("message_id", "_date").distinct().withColumn("all_day", F.lit(True))
    return left.join(by_key(days), ["message_id", "_date", "all_day"], "left_anti").select("message_id", "fingerprint")


def suspicion(status: Column, extract_it: Column, call_llm: Column, llm_called: Column, hits: Column,
              candidates: Column, missing: Column, text: Column) -> Column:
    """struct(level, reason): the first finding that applies."""
    def found(level: int, reason: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), reason.alias("reason"))

    nothing = F.struct(F.lit(NONE).alias("level"), F.lit(None).cast("string").alias("reason"))
    count = candidates.cast("string")
    failed = F.when(candidates > 0, found(LIKELY, F.concat(
        F.lit("上次抽取失败；当前代码能抽出 "), count, F.lit(" 条候选")))).otherwise(
        found(MAYBE, F.lit("该邮件上次抽取失败，且当前代码仍未抽出候选")))
    empty = (F.when(call_llm & ~llm_called, nothing)
             .when(call_llm, found(MAYBE, F.lit("预筛认为含事件线索，但规则与 LLM 都没抽出时间")))
             .otherwise(found(LIKELY, F.lit("预筛判定规则足以覆盖（未调用 LLM），但规则未命中任何时间"))))
    return (F.when(status == "failed", failed)
            .when(missing > 0, found(LIKELY, F.concat(
                F.lit("库中结果已过时：当前代码会多抽出 "), missing.cast("string"), F.lit(" 条候选"))))
            .when(extract_it & (candidates == 0), empty)
            .when(~extract_it & has_date_shape(text) & has_time_shape(text),
                  found(MAYBE, F.lit("被预筛过滤，但正文含日期与时刻形态")))
            .otherwise(nothing))


def audit_items(messages: DataFrame, events: DataFrame, now: Column, llm_responses: DataFrame | None = None,
                tz: str = DEFAULT_ZONE, contacts: DataFrame | None = None) -> DataFrame:
    """One row per message of the window with verdict, counts, suspicion and the start of its text."""
    source = messages.select(
        F.col("id").alias("message_id"), "subject", F.coalesce("body_excerpt", F.lit("")).alias("text"), "received_at",
        "auto_submitted", "is_list", F.lit(False).alias("has_ics"), "from_addr")
    verdicts, found = extract(source, now, llm_responses=llm_responses, contacts=contacts, tz=tz)
    # read by the counts and by the comparison with the store
    found = checkpointed(found)
    counts = found.groupBy("message_id").agg(F.count(F.lit(1)).alias("candidates"))
    asked = verdicts.where("extract and call_llm")
    if llm_responses is not None:
        asked = asked.join(llm_responses.select("message_id").distinct(), "message_id", "left_semi")
        called = asked.select("message_id").distinct().withColumn("llm_called", F.lit(True))
    else:
        called = None
    missing = missing_candidates(found, events, llm_responses is not None).groupBy("message_id").agg(
        F.count(F.lit(1)).alias("missing"))
    stored = events.groupBy("message_id").agg(F.count(F.lit(1)).alias("stored"))
    base = messages.withColumnRenamed("id", "message_id").join(verdicts, "message_id")
    for part in (counts, missing, stored):
        base = base.join(part, "message_id", "left")
    base = base.join(called, "message_id", "left") if called is not None else base.withColumn("llm_called", F.lit(False))
    base = base.na.fill(0, ["candidates", "missing", "stored"]).na.fill(False, ["llm_called"])
    text = F.coalesce("body_excerpt", F.lit(""))
    return base.withColumn("s", suspicion(
        F.col("extract_status"), F.col("extract"), F.col("call_llm"), F.col("llm_called"), F.col("candidates"),
        F.col("candidates"), F.col("missing"), text)).select(
        "message_id", "folder", "uid", "subject", "from_addr", "received_at", "extract_status", "extract", "call_llm",
        F.col("reason").alias("prefilter_reason"), "candidates", "missing", "stored", "llm_called",
        F.col("s.level").alias("level"), F.col("s.reason").alias("suspicion"), head_excerpt(text).alias("head"))


def audit_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("level") == LIKELY).alias("likely_missed"),
        F.count_if(F.col("level") == MAYBE).alias("maybe"), F.count_if(F.col("candidates") > 0).alias("with_candidates"),
        F.count_if(F.col("missing") > 0).alias("stale"),
        F.count_if(F.col("extract") & F.col("call_llm") & ~F.col("llm_called") & (F.col("candidates") == 0)).alias("unjudged"))


def audit_lines(items: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """The report as (section, ord, line): suspects first, then what was found, then the quiet rest."""
    section = (F.when(F.col("level") > NONE, "1-suspect").when(F.col("candidates") > 0, "2-found").otherwise("3-quiet"))
    mark = F.when(F.col("level") == LIKELY, " **[很可能漏抽]**").when(F.col("level") == MAYBE, " **[值得留意]**").otherwise("")
    head = F.concat(F.lit("### `#"), F.col("message_id").cast("string"), F.lit("` "), F.coalesce("subject", F.lit("")), mark)
    when = F.coalesce(F.date_format(local_time(F.col("received_at"), tz), "yyyy-MM-dd HH:mm"), F.lit("—"))
    full = F.array(
        head, F.concat(F.lit("- 收到："), when, F.lit(" ｜ 发件人："), F.coalesce("from_addr", F.lit(""))),
        F.concat(F.lit("- 预筛："), F.when(F.col("extract"), "值得抽取").otherwise("过滤"), F.lit("（"),
                 F.col("prefilter_reason"), F.lit("）")),
        F.concat(F.lit("- 当前候选："), F.col("candidates").cast("string"), F.lit(" ｜ 库中事件："),
                 F.col("stored").cast("string")),
        F.concat(F.lit("- ⚠️ "), F.col("suspicion")),
        F.when(F.col("level") > NONE, F.concat(F.lit("  正文开头："), fold_spaces(F.col("head")))))
    short = F.array(F.concat(F.lit("- `#"), F.col("message_id").cast("string"), F.lit("` "), F.coalesce("subject", F.lit("")),
                             F.lit(" — "), F.col("prefilter_reason")))
    lines = F.filter(F.when(section == "3-quiet", short).otherwise(full), lambda x: x.isNotNull())
    return items.select(section.alias("section"), "message_id", F.posexplode(lines).alias("ord", "line"))


def audit_document(items: DataFrame, now: Column, hours: int, tz: str = DEFAULT_ZONE) -> DataFrame:
    """(report_date, rank, key, ord, line) of the report as Markdown: title, counts, messages that only the language
    model could judge, and the sections of audit_lines under headings that say how many messages they hold.

    All headings come from one row of counts. key is the message's id as a text of fixed width, so that lines are
    ordered by message. An empty section says so. ``items`` are read four times: give stored ones.
    """
    unjudged = F.col("extract") & F.col("call_llm") & ~F.col("llm_called") & (F.col("candidates") == 0)
    quiet = (F.col("level") <= NONE) & (F.col("candidates") <= 0)
    sections = items.agg(F.count_if(F.col("level") > NONE).alias("suspect"), F.count_if(
        (F.col("level") <= NONE) & (F.col("candidates") > 0)).alias("found"), F.count_if(quiet).alias("quiet"))
    start, end = (F.date_format(local_time(at, tz), "yyyy-MM-dd HH:mm") for at in (now - F.expr(f"interval {hours} hours"), now))

    def said(text: str, column: str) -> Column:
        return F.concat(F.lit(text), F.col(column).cast("string"))

    def headed(counts: DataFrame, rank: int, *lines: Column) -> DataFrame:
        listed = F.filter(F.array(*lines), lambda x: x.isNotNull())
        return counts.select(F.lit(rank).alias("rank"), F.lit("").alias("key"), F.posexplode(listed).alias("ord", "line"))

    def number(section: str, text: str, tail: str, column: str) -> list[Column]:
        return [F.lit(""), F.concat(said(text, column), F.lit(tail)), F.lit(""),
                F.when(F.col(column) == 0, F.lit(section))]

    totals = audit_counts(items)
    parts = [
        headed(totals, 0, F.concat(F.lit("# 抽取复盘 · "), F.substring(end, 1, 10)), F.lit(""),
               F.concat(F.lit(f"窗口：最近 {hours} 小时（"), start, F.lit(" → "), end, F.lit(f" {tz}）")),
               F.concat(said("邮件 ", "messages"), said(" 封 ｜ 很可能漏抽 ", "likely_missed"), said(" ｜ 值得留意 ", "maybe"),
                        said(" ｜ 已抽出 ", "with_candidates"), said(" ｜ 库中结果过时 ", "stale"),
                        F.when(F.col("unjudged") > 0, said(" ｜ 未判定 ", "unjudged")).otherwise(""))),
        headed(totals.where("unjudged > 0"), 1, F.lit(""), F.concat(said("### 未判定（", "unjudged"), F.lit(
            " 封，需 LLM 才能判断）")), F.lit("")),
        headed(sections, 2, *number("没有可疑项。", "## 需要你看一眼（", " 封）", "suspect")),
        headed(sections, 3, *number("无。", "## 已抽出候选（", " 封）", "found")),
        headed(sections, 4, F.lit(""), F.concat(said("## 其余（", "quiet"), F.lit(" 封，未抽出且无明显线索）")), F.lit(""))]
    key = F.lpad(F.col("message_id").cast("string"), 20, "0").alias("key")
    lines = audit_lines(items, tz)
    parts.append(lines.select((F.substring("section", 1, 1).cast("int") + 1).alias("rank"), key, "ord", "line"))
    parts.append(items.where(unjudged).select(F.lit(1).alias("rank"), key, F.lit(0).alias("ord"), F.concat(
        F.lit("- `#"), F.col("message_id").cast("string"), F.lit("` "), F.coalesce("subject", F.lit("")), F.lit(" — "),
        F.col("prefilter_reason")).alias("line")))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select(F.substring(end, 1, 10).alias("report_date"), "rank", "key", F.col("ord").cast("long").alias("ord"), "line")
