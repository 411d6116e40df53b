"""Parsing queries: the given texts and pages are put into raw messages and calendar parts, then read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.functions.common import flag, iso_utc
from mailspark.operators.candidates import extract
from mailspark.queries.texts import _html
from mailspark.queries.views import NOW, cal_events, now, CAL_EVENTS, with_ctes
from mailspark.sources.decoding import STATISTICAL, decoded, learn_charsets
from mailspark.sources.ics import parse_ics as read_ics
from mailspark.sources.raw import parse_messages as read_messages
from mailspark.sources.tables import load, spread


def _crlf(*lines: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return F.concat_ws("\r\n", *parts)


def _raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    kt = k.cast("string")
    subject = F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Título "), kt), "UTF-8")), F.lit("?="))
    head = _crlf(
        F.concat(F.lit('From: "Sender '), kt, F.lit('" <User'), kt, F.lit("@Mail.Example>")),
        F.concat(F.lit("To: a@x.example, B <B@Y.example>")), subject,
        F.concat(F.lit("Message-ID: <D"), kt, F.lit("@Docs.Example>")),
        F.concat(F.lit("References: <r1@A.b> <r"), kt, F.lit("@C.d>")), "Date: Tue, 03 Mar 2026 10:00:00 +0800",
        F.when(k % 3 == 0, "List-Unsubscribe: <mailto:u@l.example>").otherwise("X-Other: 1"),
        F.when(k % 5 == 0, "Auto-Submitted: auto-generated").otherwise("Auto-Submitted: no"), "MIME-Version: 1.0")
    body = F.base64(F.encode("text", "UTF-8"))
    single = _crlf(head, "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", body)
    multi = _crlf(
        head, 'Content-Type: multipart/mixed; boundary="bb"', "", "--bb", "Content-Type: text/html; charset=utf-8", "",
        "<p>short</p>", "--bb", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", "", body,
        "--bb", 'Content-Type: application/octet-stream; name="x.ics"', "Content-Disposition: attachment; filename=x.ics", "",
        "BEGIN:VCALENDAR", "END:VCALENDAR", "--bb--", "")
    raw = F.encode(F.when(k % 2 == 0, single).otherwise(multi), "UTF-8")
    return spread(load(spark, folder, "documents"), rows=2_000).select("doc_id", raw.alias("raw"))


def parse_messages(spark: SparkSession, folder: str) -> DataFrame:
    parsed = read_messages(_raw_documents(spark, folder))
    return parsed.select(
        "doc_id", "subject", "from_addr", "from_name", F.array_join("to_addrs", ",").alias("to_addrs"),
        "normalized_message_id", F.array_join("references_ids", " ").alias("refs"), iso_utc(F.col("sent_at")).alias("sent_at"),
        flag(F.col("has_unsubscribe")).alias("has_unsubscribe"), F.coalesce("auto_submitted", F.lit("")).alias(
            "auto_submitted"), flag(F.col("has_ics")).alias("has_ics"), "body_sha256")


def parse_html_messages(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(load(spark, folder, "pages"))
    raw = F.encode(_crlf("From: web@x.example", "Subject: page", "Content-Type: text/html; charset=utf-8",
                         "Content-Transfer-Encoding: base64", "", F.base64(F.encode("html", "UTF-8"))), "UTF-8")
    parsed = read_messages(pages.select("page_id", raw.alias("raw")))
    return parsed.select("page_id", "body_sha256", flag(F.col("had_html")).alias("had_html"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("id")
    kt = k.cast("string")
    start = F.when(k % 4 == 0, F.concat(F.lit("DTSTART:"), F.date_format("start_ts", "yyyyMMdd'T'HHmmss'Z'"))).when(
        k % 4 == 1, F.concat(F.lit("DTSTART;TZID=Asia/Tokyo:"), F.date_format("start_ts", "yyyyMMdd'T'HHmmss"))).when(
        k % 4 == 2, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("start_ts", "yyyyMMdd"))).otherwise(
        F.concat(F.lit('DTSTART;TZID="No/Where":'), F.date_format("start_ts", "yyyyMMdd'T'HHmmss")))
    event = _crlf(
        "BEGIN:VEVENT", F.concat(F.lit("UID:u"), kt, F.lit("@cal")),
        F.concat(F.lit("SUMMARY:Meet\\, plan and a line long\r\n  enough no "), kt), start,
        F.when(k % 4 == 0, F.concat(F.lit("DTEND:"), F.date_format(F.col("start_ts") + F.expr("INTERVAL 2 HOURS"),
                                                                    "yyyyMMdd'T'HHmmss'Z'"))).otherwise("X-A:1"),
        F.concat(F.lit("SEQUENCE:"), F.when(k % 10 == 9, "bad").otherwise((k % 5).cast("string"))),
        F.concat(F.lit("ORGANIZER;CN=\"A: B\":mailto:O"), kt, F.lit("@x.example")),
        F.when(k % 6 == 0, "RRULE:FREQ=WEEKLY;COUNT=3").otherwise("X-B:1"),
        F.when(k % 7 == 0, "STATUS:CANCELLED").otherwise("STATUS:CONFIRMED"),
        "BEGIN:VALARM", "SUMMARY:alarm", "END:VALARM", "END:VEVENT")
    text = _crlf("BEGIN:VCALENDAR", F.concat(F.lit("METHOD:"), F.when(k % 9 == 0, "CANCEL").otherwise("REQUEST")), event,
                 "BEGIN:VEVENT", F.concat(F.lit("UID:second"), kt), "END:VEVENT", "END:VCALENDAR", "")
    return cal_events(spark, folder, spread(load(spark, folder, "orders"))).where("start_ts is not null").select(
        k.alias("message_id"), F.encode(text, "UTF-8").alias("raw"))


def parse_ics(spark: SparkSession, folder: str) -> DataFrame:
    found = read_ics(_parts(spark, folder))
    return found.select(
        "message_id", "uid", "summary", F.coalesce(iso_utc(F.col("start_ts")), F.lit("")).alias("start_ts"),
        F.coalesce(iso_utc(F.col("end_ts")), F.lit("")).alias("end_ts"), flag(F.col("all_day")).alias("all_day"),
        F.coalesce("sequence", F.lit(-1)).cast("long").alias("sequence"), F.coalesce("rrule", F.lit("")).alias("rrule"),
        F.coalesce("organizer", F.lit("")).alias("organizer"), "method", flag(F.col("is_cancellation")).alias("cancelled"))


def raw_to_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Raw calendar parts through the gates and the merge: how many entries may go out by themselves, and why not."""
    parts = _parts(spark, folder)
    messages = parts.select("message_id", F.lit("invite").alias("subject"), F.lit("").alias("text"), now().alias("received_at"),
                            F.lit(None).cast("string").alias("auto_submitted"), F.lit(False).alias("is_list"),
                            F.lit(True).alias("has_ics"), F.lit("a@x").alias("from_addr"))
    _, found = extract(messages, now(), vevents=read_ics(parts))
    return found.where("start_ts is not null").groupBy("review_reason").agg(F.count(F.lit(1)).alias("n"))


def _encoded(docs: DataFrame) -> DataFrame:
    """doc_id, data, declared: each document in one of six charsets, with no declaration or a wrong one."""
    wrong = (None, "us-ascii", "gb2312", "utf-8", "x-unknown", "iso-8859-1", "big5")

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            kinds = [STATISTICAL[i % len(STATISTICAL)] for i in ids]
            data = [(t or "").encode(c, "replace") for t, c in zip(batch["text"].to_pylist(), kinds)]
            told = [wrong[i % len(wrong)] for i in ids]
            yield pa.record_batch([batch["doc_id"], pa.array(data, pa.binary()), pa.array(told, pa.string())], names=["doc_id", "data", "declared"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, data binary, declared string")


def decode_charsets(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts from bytes that say nothing true about themselves; the model knows a fifth of the texts.
    Texts under 40 characters may be too short to tell."""
    docs = load(spark, folder, "documents")
    model = learn_charsets(docs.where("doc_id % 5 = 0"))
    text = F.col("data")
    return decoded(_encoded(spread(docs)), "data", "declared", model).join(
        docs.select("doc_id", (F.length("text") >= 40).alias("long")), "doc_id").select(
        "doc_id", F.when(F.col("long"), F.sha2(text, 256)).otherwise("").alias("text_sha256"))


QUERIES = {"decode_charsets": decode_charsets, "parse_messages": parse_messages, "parse_html_messages": parse_html_messages, "parse_ics": parse_ics,
           "raw_to_candidates": raw_to_candidates}

_ICS = """ics AS (SELECT id AS k, 'u' || id || '@cal' AS uid,
  'Meet, plan and a line long enough no ' || id || CASE WHEN id % 6 = 0 THEN ' (重复)' ELSE '' END AS summary,
  CASE id % 4 WHEN 0 THEN date_trunc('second', start_ts) WHEN 1 THEN start_ts - INTERVAL 9 HOUR
    WHEN 2 THEN CAST(CAST(start_ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR ELSE start_ts - INTERVAL 8 HOUR END AS s,
  id % 4 = 2 AS all_day, id % 5 AS seq, CASE WHEN id % 6 = 0 THEN 'FREQ=WEEKLY;COUNT=3' ELSE '' END AS rrule,
  'O' || id || '@x.example' AS organizer, CASE WHEN id % 9 = 0 THEN 'CANCEL' ELSE 'REQUEST' END AS method,
  id % 9 = 0 OR id % 7 = 0 AS cancelled FROM cal_events WHERE start_ts IS NOT NULL)"""

ORACLES = {
    "decode_charsets": "SELECT doc_id, CASE WHEN length(text) >= 40 THEN sha256(text) ELSE '' END AS text_sha256 FROM documents",
    "parse_messages": """SELECT doc_id, 'Título ' || doc_id AS subject, 'user' || doc_id || '@mail.example' AS from_addr, 'Sender ' || doc_id AS from_name,
  'a@x.example,b@y.example' AS to_addrs, 'D' || doc_id || '@docs.example' AS normalized_message_id, 'r1@a.b r' || doc_id || '@c.d' AS refs,
  '2026-03-03T02:00:00Z' AS sent_at, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS has_unsubscribe,
  CASE WHEN doc_id % 5 = 0 THEN 'Auto-Submitted: auto-generated' ELSE '' END AS auto_submitted, doc_id % 2 AS has_ics, sha256(text) AS body_sha256
FROM documents""",
    "parse_html_messages": f"SELECT page_id, sha256({_html()}) AS body_sha256, 1 AS had_html FROM pages",
    "parse_ics": with_ctes("""SELECT k AS message_id, uid, summary, strftime(s, '%Y-%m-%dT%H:%M:%SZ') AS start_ts,
  CASE WHEN k % 4 = 0 THEN strftime(s + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN all_day THEN '' ELSE strftime(s + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS end_ts,
  CASE WHEN all_day THEN 1 ELSE 0 END AS all_day, seq AS sequence, rrule, organizer, method, CASE WHEN cancelled THEN 1 ELSE 0 END AS cancelled
FROM ics WHERE k % 10 <> 9
UNION ALL SELECT k, 'second' || k, '(无标题)', '', '', 0, -1, '', '', method, CASE WHEN method = 'CANCEL' THEN 1 ELSE 0 END FROM ics""", CAL_EVENTS, _ICS),
    "raw_to_candidates": with_ctes(f"""SELECT review_reason, count(*) AS n FROM (SELECT concat_ws('；', CASE WHEN cancelled THEN '取消通知：必须人工裁决' END,
  CASE WHEN method = 'CANCEL' THEN '非 REQUEST（METHOD=CANCEL）' END, CASE WHEN s < TIMESTAMP '{NOW}' THEN '时间已过（早于当前时刻，不建议入历）' END) AS review_reason
  FROM ics WHERE k % 10 <> 9) GROUP BY 1""", CAL_EVENTS, _ICS),
}
