"""Calendar stamps and their zones: looked up, not searched for along the list of all zones."""

from pyspark.sql import functions as F

from mailspark.functions.common import iso_utc
from mailspark.sources.ics import parse_ics


def entry(stamp: str) -> str:
    return f"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u\r\nSUMMARY:s\r\n{stamp}\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"


def test_zones_are_looked_up(spark):
    stamps = {"DTSTART;TZID=Asia/Tokyo:20260105T090000": "2026-01-05T00:00:00Z", "DTSTART;TZID=UTC:20260105T090000": "2026-01-05T09:00:00Z",
              'DTSTART;TZID="America/New_York":20260705T090000': "2026-07-05T13:00:00Z", "DTSTART;TZID=asia/tokyo:20260105T090000": "2026-01-05T01:00:00Z",
              "DTSTART;TZID=No/Where:20260105T090000": "2026-01-05T01:00:00Z", "DTSTART:20260105T090000": "2026-01-05T01:00:00Z",
              "DTSTART;VALUE=DATE:20260105": "2026-01-04T16:00:00Z", "X-NONE:1": None}
    found = parse_ics(spark.createDataFrame([(k, entry(s)) for k, s in enumerate(stamps)], "message_id long, raw string"), tz="Asia/Shanghai")
    rows = {r.message_id: r.s for r in found.select("message_id", iso_utc(F.col("start_ts")).alias("s")).collect()}
    assert rows == dict(enumerate(stamps.values()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "INSET" in plan
