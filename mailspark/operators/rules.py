"""Deterministic extraction: paragraphs, dates paired with times, titles, confidence, review gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import casefold, contains_any, join_nonempty, local_day, with_once
from mailspark.functions.dates import dates_in, may_hold_date, times_in
from mailspark.functions.fingerprint import event_fingerprint
from mailspark.functions.text import is_footnote, paragraphs_of
from mailspark.functions.titles import choose_title, clean_fragment, subject_title, time_sentence

DEFAULT_ZONE = "Asia/Shanghai"
DEFAULT_MINUTES = 30


def rule_hits(messages: DataFrame, tz: str = DEFAULT_ZONE, minutes: int = DEFAULT_MINUTES) -> DataFrame:
    """One row per (message, date, time) found.

    Input: message_id, subject, text, received_at. The text is dropped as soon as its paragraphs are read, so
    the only exchange (on message_id) carries thin rows; all windows below share it.
    """
    subject = F.coalesce(F.col("subject"), F.lit(""))
    hay = casefold(F.concat(subject, F.lit("\n"), F.col("_body")))
    # the gate reads the text as a column: it is not repeated below an exchange that deals the messages out
    paragraphs = (
        with_once(messages.select("message_id", "subject", "text", "received_at"), _body=F.coalesce(F.col("text"), F.lit("")))
        .where(may_hold_date(F.col("_body")))
        .select(
            "message_id", "received_at", subject.alias("subject"),
            contains_any(hay, lx.DEADLINE_KEYWORDS).alias("is_deadline"),
            local_day(F.col("received_at"), tz).alias("received_day"),
            F.posexplode(F.filter(paragraphs_of(F.col("text")), lambda p: may_hold_date(p) & ~is_footnote(p)))
            .alias("p_ord", "paragraph")))
    dated = with_once(paragraphs, dates=dates_in(F.col("paragraph"), F.col("received_day"))).where(
        F.size("dates") > 0)
    read = with_once(
        dated, times=times_in(F.col("paragraph")), fragment=clean_fragment(time_sentence(F.col("paragraph"))),
        from_subject=subject_title(F.col("subject")), vague=contains_any(F.col("paragraph"), lx.VAGUE_WORDS))
    timed = read.withColumn("named", choose_title(F.col("fragment"), F.col("from_subject"), F.col("subject")))
    hits = (
        timed.select(
            "message_id", "received_at", "is_deadline", "p_ord", "vague", "named.title", "named.title_from_subject",
            F.size("dates").alias("n_dates"), "times", F.posexplode("dates").alias("d_ord", "date"))
        .withColumn("time", F.get(F.col("times"), F.col("d_ord")))
        .withColumn("has_time", F.col("time").isNotNull())
        .withColumn("start_ts", local_instant(F.col("date.day"), F.col("time.h"), F.col("time.mi"), tz))
        .withColumn("hit_evidence", join_nonempty(" + ", F.col("date.ev"), F.col("time.ev"))))
    message = Window.partitionBy("message_id")
    same = Window.partitionBy("message_id", "date.day", "time.h", "time.mi").orderBy("p_ord", "d_ord")
    kept = (
        hits.repartition("message_id")
        .withColumn("max_dates", F.max("n_dates").over(message))
        .withColumn("_first", F.row_number().over(same))
        .where("_first = 1")
        .withColumn("ambiguous", (F.count(F.lit(1)).over(message) > 1) & (F.col("max_dates") > 1)))
    return kept.select(
        "message_id", "received_at", (F.shiftleft(F.col("p_ord").cast("long"), 32) + F.col("d_ord")).alias("hit_ord"),
        "title", "title_from_subject", "start_ts",
        F.when(~F.col("is_deadline"), F.col("start_ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("end_ts"),
        (F.col("is_deadline") | ~F.col("has_time")).alias("all_day"),
        F.col("hit_evidence").alias("evidence"), "has_time", F.col("date.has_year").alias("has_year"),
        "is_deadline", "vague", "ambiguous")


def local_instant(day: Column, hour: Column, minute: Column, tz: str) -> Column:
    """The UTC instant of a local day and clock; a missing clock means midnight."""
    wall = F.date_format(day, "yyyy-MM-dd")
    clock = F.concat(F.lpad(F.coalesce(hour, F.lit(0)).cast("string"), 2, "0"), F.lit(":"),
                     F.lpad(F.coalesce(minute, F.lit(0)).cast("string"), 2, "0"), F.lit(":00"))
    return F.to_utc_timestamp(F.to_timestamp(F.concat(wall, F.lit(" "), clock), "yyyy-MM-dd HH:mm:ss"), tz)


def confidence(has_time: Column, has_year: Column, ambiguous: Column, vague: Column,
               relative_weight: float | None = None, relative: Column | None = None) -> Column:
    """Weight of the pattern times its discounts. ``relative_weight`` switches on the documented lower weight."""
    base = F.when(has_time, F.lit(lx.WEIGHT_WITH_TIME)).otherwise(F.lit(lx.WEIGHT_NO_TIME))
    if relative_weight is not None and relative is not None:
        base = F.when(relative, F.lit(relative_weight)).otherwise(base)
    score = (base * F.when(has_year, F.lit(1.0)).otherwise(F.lit(lx.FACTOR_NO_YEAR))
             * F.when(ambiguous, F.lit(lx.FACTOR_AMBIGUOUS)).otherwise(F.lit(1.0))
             * F.when(vague, F.lit(lx.FACTOR_VAGUE)).otherwise(F.lit(1.0)))
    return F.round(F.least(score.cast("double"), F.lit(1.0)), 4)


def review_reason(start_ts: Column, has_year: Column, ambiguous: Column, vague: Column, received_at: Column,
                  score: Column, now: Column, threshold: float = lx.AUTO_PUSH_THRESHOLD,
                  ambiguous_policy: str = "pending") -> Column:
    """The first gate a hit fails, '' when it passes all of them."""
    gate = F.when(start_ts < now, F.lit(lx.GATE_PAST)).when(~has_year, F.lit(lx.GATE_NO_YEAR))
    if ambiguous_policy != "earliest":
        gate = gate.when(ambiguous, F.lit(lx.GATE_AMBIGUOUS))
    before, after = lx.GATE_THRESHOLD
    return (gate.when(vague, F.lit(lx.GATE_VAGUE))
            .when(start_ts < received_at, F.lit(lx.GATE_BEFORE_RECEIVED))
            .when(score <= threshold, F.concat(F.lit(before), score.cast("string"), F.lit(after)))
            .otherwise(F.lit("")))


def rule_candidates(hits: DataFrame, now: Column, tz: str = DEFAULT_ZONE, threshold: float = lx.AUTO_PUSH_THRESHOLD,
                    ambiguous_policy: str = "pending") -> DataFrame:
    """Scored and gated hits in the candidate layout."""
    scored = hits.withColumn("confidence", confidence(
        F.col("has_time"), F.col("has_year"), F.col("ambiguous"), F.col("vague")))
    gated = scored.withColumn("review_reason", review_reason(
        F.col("start_ts"), F.col("has_year"), F.col("ambiguous"), F.col("vague"), F.col("received_at"),
        F.col("confidence"), now, threshold, ambiguous_policy))
    text = F.lit(None).cast("string")
    return gated.select(
        "message_id", F.col("hit_ord").alias("ord"), "title", "start_ts", "end_ts", "all_day",
        F.lit("rules").alias("source"), "confidence",
        event_fingerprint(F.col("title"), F.col("start_ts"), F.col("end_ts"), text, text).alias("fingerprint"),
        "evidence", text.alias("location"), text.alias("organizer"), F.lit(tz).alias("tz"),
        text.alias("ics_uid"), F.lit(None).cast("int").alias("ics_sequence"), text.alias("ics_recurrence_id"),
        text.alias("ics_rrule"), (F.col("review_reason") != "").alias("requires_review"), "review_reason",
        "title_from_subject")
