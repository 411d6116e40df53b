"""Which messages can hold an event, and which of them deserve the costly fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import casefold, let, with_once, words_found
from mailspark.functions.text import has_date_shape, has_time_shape, paragraphs_of

_NO_WORDS = "cast(array() as array<string>)"


def pairs_in_paragraph(text: Column) -> Column:
    """Some paragraph holds both a date and a time."""
    return F.exists(paragraphs_of(text), lambda p: has_date_shape(p) & has_time_shape(p))


def classify(messages: DataFrame, subject: str = "subject", text: str = "body_excerpt",
             auto_submitted: str = "auto_submitted", is_list: str = "is_list", has_ics: str = "has_ics") -> DataFrame:
    """Add ``verdict`` struct(extract, call_llm, reason, score, matched) to each message.

    The word lists are scanned once per row; every later test reads the arrays of words found.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hay = casefold(F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), body))
    clues = let(hay, lambda h: F.struct(
        words_found(h, lx.NOISE_KEYWORDS).alias("noise"), words_found(h, lx.EVENT_KEYWORDS).alias("event"),
        words_found(h, lx.MARKETING_KEYWORDS).alias("marketing"), has_date_shape(body).alias("date"),
        has_time_shape(body).alias("time")))
    staged = with_once(messages, _clues=clues)
    shapes = F.col("_clues.date") & F.col("_clues.time")
    staged = with_once(staged, _paired=shapes & pairs_in_paragraph(body))
    verdict = _verdict(F.col("_clues"), F.col("_paired"), F.col(auto_submitted), F.col(is_list), F.col(has_ics))
    return with_once(staged, verdict=verdict).drop("_clues", "_paired")


def _verdict(clues: Column, paired: Column, machine: Column, is_list: Column, has_ics: Column) -> Column:
    """The ordered tests: exclusions first, then clues, then whether rules can be expected to cover them."""
    event, marketing = clues["event"], clues["marketing"]
    no_event = F.size(event) == 0
    score = (F.size(event) * 3 + F.when(clues["date"], 2).otherwise(0)
             + F.when(clues["time"], 3).otherwise(0)).cast("int")
    call_llm = ~no_event & ~paired

    def top3(words: Column) -> Column:
        return F.array_join(F.slice(words, 1, 3), ", ")

    reason = F.concat(
        F.lit("含事件线索"),
        F.when(no_event, F.lit("")).otherwise(F.concat(F.lit("（关键词："), top3(event), F.lit("）"))),
        F.when(~call_llm, F.lit("；同段内日期与时刻配对完整，规则应能覆盖"))
        .when(clues["date"] & clues["time"], F.lit("；日期与时刻分处不同段落，规则无法配对，值得 LLM 兜底"))
        .otherwise(F.lit("；时间形态不完整，值得 LLM 兜底")))

    def verdict(extract: bool, llm: Column, why: Column, points: Column, words: Column) -> Column:
        return F.struct(F.lit(extract).alias("extract"), llm.alias("call_llm"), why.alias("reason"),
                        points.alias("score"), words.alias("matched"))

    def skip(why: Column, points: int | Column, words: Column | None = None) -> Column:
        points = F.lit(points) if isinstance(points, int) else points
        return verdict(False, F.lit(False), why, points, F.expr(_NO_WORDS) if words is None else words)

    return (
        F.when(has_ics, verdict(True, F.lit(False), F.lit("含 ICS 日历部件，可直接解析"), F.lit(100),
                                F.array(F.lit("ics"))))
        .when(F.length(machine) > 0, skip(F.concat(F.lit("自动投递邮件（"), machine, F.lit("）")), -50))
        .when(F.size(clues["noise"]) > 0, skip(F.lit("验证码类邮件"), -40, clues["noise"]))
        .when((F.size(marketing) > 0) & no_event,
              skip(F.concat(F.lit("营销/推广类邮件（命中 "), top3(marketing), F.lit("）")), -20, marketing))
        .when(is_list & no_event, skip(F.lit("群发列表邮件且无事件线索"), -10))
        .when(no_event & ~paired, skip(F.lit("未发现事件线索（无事件关键词，也无同段的日期+时刻）"), score, event))
        .otherwise(verdict(True, call_llm, reason, score, F.array_distinct(event))))


def actionable_signal(subject: Column, sender: Column) -> Column:
    """The first word in subject or sender that asks for a reaction, else null."""
    hay = casefold(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(sender, F.lit(""))))
    return let(hay, lambda h: F.get(words_found(h, lx.ACTIONABLE_SIGNALS), F.lit(0)))
