"""Calendar parts to one row per VEVENT, with column expressions only."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import iso_utc, nonempty, sub, with_once
from mailspark.functions.fingerprint import ics_fingerprint
from mailspark.operators.rules import DEFAULT_MINUTES, DEFAULT_ZONE

_PARAMS = r'((?:;(?:[^:\n";]++|"[^"\n]*+")*+)*+)'


def strip(value: Column) -> Column:
    """common.strip() of a short value, as one pattern: it stays in the code that is generated for a stage."""
    return sub(value, r"^\s+|\s+\z")


def _property(name: str, group: int = 2) -> Column:
    """The value of the first line of a name, or its parameters (group 1); '' when absent."""
    return F.regexp_extract("_block", rf"(?imd)^{name}{_PARAMS}:(.*)$", group)


def _text(name: str) -> Column:
    """A text value with its escapes undone."""
    return strip(F.regexp_replace(F.regexp_replace(_property(name), r"\\[nN]", "\n"), r"\\([,;\\])", "$1"))


def _zone(name: str) -> Column:
    """The zone that the parameters of a stamp name; '' when absent."""
    return F.regexp_replace(F.regexp_extract(_property(name, 1), r'(?i);TZID=("[^"]*"|[^;:]*)', 1), '"', "")


def _known_zone(name: Column) -> Column:
    """Looked up in a hash set: the list has hundreds of names."""
    return name.isin(sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT")))


def _instant(value: Column, named: Column, tz: str) -> Column:
    """UTC instant of a DATE or DATE-TIME value; a zone that is unknown counts as the user's."""
    stamp = F.try_to_timestamp(F.substring(value, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    zone = F.when((F.length(named) > 0) & _known_zone(named), named).otherwise(F.lit(tz))
    return (F.when(value.rlike(r"^\d{8}T\d{6}Z$"), stamp)
            .when(value.rlike(r"^\d{8}T\d{6}$"), F.to_utc_timestamp(stamp, zone))
            .when(value.rlike(r"^\d{8}$"), F.to_utc_timestamp(F.try_to_timestamp(value, F.lit("yyyyMMdd")), F.lit(tz))))


def _stages(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for cols in stages:
        df = with_once(df, **cols)
    return df


def parse_ics(parts: DataFrame, tz: str = DEFAULT_ZONE, minutes: int = DEFAULT_MINUTES,
              raw: str = "raw") -> DataFrame:
    """(message_id, raw) to VEVENT rows. Recurrence rules are kept as text, not expanded; an entry with a broken
    sequence number is dropped, its neighbours are kept."""
    text = F.regexp_replace(F.regexp_replace(F.try_validate_utf8(F.col(raw).cast("string")), r"\r\n?", "\n"),
                            r"\n[ \t]", "")
    # each value is read once, in columns: a filter on them does not go below the exchange that deals the parts out
    blocks = (with_once(parts, _text=text).where(F.col("_text").isNotNull())
              .withColumn("method", strip(F.regexp_extract("_text", r"(?im)^METHOD(?:;[^:\n]*)?:(.*)$", 1)))
              .select("message_id", nonempty(F.col("method")).alias("method"), F.posexplode(F.regexp_extract_all(
                  "_text", F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("ord", "_block")))
    opened = with_once(blocks.withColumn("_block", F.regexp_replace("_block", r"(?s)BEGIN:VALARM.*?END:VALARM", "")),
                       _sequence=strip(_property("SEQUENCE")))
    sequence = F.col("_sequence")
    sound = opened.where((sequence == "") | sequence.rlike(r"^[+-]?\d{1,9}$"))
    # few columns at a time: what is generated for a stage of many is a method too long to be compiled by the JVM
    values = _stages(
        sound, {"_uid": _text("UID"), "_title": _text("SUMMARY"), "_place": _text("LOCATION")},
        {"_status": _text("STATUS"), "_rrule": strip(_property("RRULE")), "_owner": _text("ORGANIZER")},
        {"_again": strip(_property("RECURRENCE-ID")), "_again_text": _text("RECURRENCE-ID"), "_again_zone": _zone("RECURRENCE-ID")},
        {"_from": strip(_property("DTSTART")), "_from_zone": _zone("DTSTART")}, {"_to": strip(_property("DTEND")), "_to_zone": _zone("DTEND")})
    fields = _stages(values, {
        "uid": nonempty(F.col("_uid")), "_summary": F.coalesce(nonempty(F.col("_title")), F.lit(lx.NO_TITLE)),
        "location": nonempty(F.col("_place")), "status": nonempty(F.col("_status")), "rrule": nonempty(F.col("_rrule")),
        "sequence": nonempty(sequence).cast("int"),
        "organizer": F.regexp_replace(nonempty(F.col("_owner")), r"^[^:]*:\s*(?=\S)", "")}, {
        "recurrence_id": F.coalesce(iso_utc(_instant(F.col("_again"), F.col("_again_zone"), tz)), nonempty(F.col("_again_text")))}, {
        "start_ts": _instant(F.col("_from"), F.col("_from_zone"), tz), "all_day": F.col("_from").rlike(r"^\d{8}$")}, {
        "_end": _instant(F.col("_to"), F.col("_to_zone"), tz)})
    cancelled = F.coalesce(F.upper("method") == "CANCEL", F.lit(False)) | F.coalesce(
        F.upper("status") == "CANCELLED", F.lit(False))
    evidence = F.concat_ws(
        " | ", F.concat(F.lit("ICS UID="), F.coalesce("uid", F.lit("None"))), F.concat(F.lit("SUMMARY="), "_summary"),
        F.concat(F.lit("DTSTART="), iso_utc(F.col("start_ts"))),
        F.concat(F.lit("RRULE="), "rrule", F.lit("(v1 不展开)")), F.when(cancelled, F.lit("METHOD/STATUS 表示取消")))
    return fields.select(
        "message_id", "ord", "uid",
        F.concat_ws(" ", "_summary", F.when(F.col("rrule").isNotNull(), F.lit(lx.RRULE_NOTE))).alias("summary"),
        "start_ts", F.coalesce("_end", F.when(~F.col("all_day"), F.col("start_ts") + F.make_dt_interval(
            mins=F.lit(minutes)))).alias("end_ts"),
        "all_day", "sequence", "recurrence_id", "rrule", "location", "organizer", "method", "status",
        cancelled.alias("is_cancellation"),
        F.coalesce(ics_fingerprint(F.col("uid"), F.col("recurrence_id"), F.col("organizer")), F.lit("")).alias(
            "fingerprint"),
        evidence.alias("evidence"))
