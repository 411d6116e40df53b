"""Versioned tables, reports, streams and reconcile cases."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from mailspark.functions import payload as pl
from mailspark.operators import reconcile as rc, store as st
from mailspark.sources import sinks
from mailspark.streaming import jobs
from tests.conftest import rows


def test_versions_and_half_written_leftovers(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "senders"), "senders")
    assert table.read().count() == 0
    one = spark.createDataFrame([("a", "x@y", "n", 1, 0, 0, None, False, None)], table.read().schema)
    assert table.write(one) == 1
    # the new version is computed from the old one while that is read
    assert table.write(table.read().withColumn("total", F.col("total") + 1)) == 2
    (tmp_path / "senders" / "v=3").mkdir()
    assert table.read().first()["total"] == 2
    assert table.write(table.read()) == 3


def test_report_of_a_day_replaces_only_that_day(spark, tmp_path):
    def lines(day, text):
        return spark.createDataFrame([(day, "s", 0, text)], "digest_date string, section string, ord long, line string")

    path = str(tmp_path / "digest")
    for day, text in (("2026-01-01", "old"), ("2026-01-02", "two"), ("2026-01-01", "new")):
        sinks.write_report(lines(day, text), path)
    got = rows(spark.read.parquet(path).select(F.col("digest_date").cast("string").alias("d"), "line"), "d")
    assert [(r["d"], r["line"]) for r in got] == [("2026-01-01", "new"), ("2026-01-02", "two")]


def test_ingest_stream_survives_repeats_and_restarts(spark, tmp_path):
    schema = "account string, folder string, uid_validity long, uid long, body string"
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def arrive(uids):
        spark.createDataFrame([("a", "f", 1, u, "b") for u in uids], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.ingest_stream(stream, target, log).awaitTermination()

    arrive([1, 2, 2, 3])
    arrive([3, 4])
    arrive([1, 5])
    assert sorted(r["uid"] for r in rows(spark.read.parquet(target))) == [1, 2, 3, 4, 5]


def test_upsert_twice_changes_nothing(spark):
    table = spark.createDataFrame([("a", 1, 5)], "k string, total long, top long")
    change = spark.createDataFrame([("a", 2, 3), ("b", 7, None)], "k string, total long, top long")
    rules = {"top": st.larger}
    once = st.upsert(table, change, ["k"], rules)
    twice = st.upsert(once, change, ["k"], rules)
    assert rows(once, "k") == rows(twice, "k") == [{"k": "a", "total": 2, "top": 5}, {"k": "b", "total": 7, "top": None}]


def _payload(summary, start="2026-09-20T10:00:00+08:00", owner="fp1", **extra):
    body = {"summary": summary, "start": {"dateTime": start}, "end": {"date": "2026-09-21"},
            "extendedProperties": {"private": {pl.OWNER_KEY: owner}}, **extra}
    return json.dumps(body)


def test_ownership_verdicts(spark):
    cases = [  # id, last etag, remote etag, remote payload, local differs, expected
        ("same_etag", "e1", "e1", _payload("changed"), False, "no_change"),
        ("rewritten", "e1", "e2", _payload(" Plan  A\n", "2026-09-20T02:00:00Z", id="9", updated="z"), False, "benign_evolution"),
        ("edited", "e1", "e2", _payload("Plan B"), False, "externally_modified"),
        ("both", "e1", "e2", _payload("Plan B"), True, "conflict"),
        ("gone", "e1", None, None, False, "not_found"),
        ("stranger", "e1", "e1", _payload("Plan A", owner="zz"), False, "not_owned"),
    ]
    snapshot = _payload("Plan A")
    local = spark.createDataFrame([(c[0], f"g-{c[0]}", c[1], "fp1", snapshot, c[4]) for c in cases],
                                  "name string, gcal_event_id string, gcal_etag string, owner_key string, "
                                  "snapshot_payload string, differs boolean")
    local = local.withColumn("snapshot_hash", pl.canonical_hash(pl.canonical(pl.parse_payload(F.col("snapshot_payload"))))).withColumn(
        "local_hash", F.when(F.col("differs"), F.lit("other")).otherwise(F.col("snapshot_hash")))
    remote = spark.createDataFrame([(f"g-{c[0]}", c[2], c[3]) for c in cases if c[3]], "event_id string, etag string, payload string")
    got = {r["name"]: r for r in rows(rc.compare(local, rc.remote_copies(remote)))}
    assert {k: v["verdict"] for k, v in got.items()} == {c[0]: c[5] for c in cases}
    assert [d["field"] for d in got["edited"]["differences"]] == ["summary"]
    assert "我方='Plan A' → 远端='Plan B'" in got["edited"]["detail"]


def test_all_day_payload_dates(spark):
    # local midnight of 1 October is stored on 30 September in UTC
    df = spark.createDataFrame([(datetime(2026, 9, 30, 16), None), (datetime(2026, 9, 30, 16), datetime(2026, 10, 2, 16))],
                               "s timestamp, e timestamp")
    first, last = pl.all_day_dates(F.col("s"), F.col("e"), "Asia/Shanghai")
    got = [(str(r["f"]), str(r["l"])) for r in df.select(first.alias("f"), last.alias("l")).collect()]
    assert got == [("2026-10-01", "2026-10-02"), ("2026-10-01", "2026-10-03")]


def test_eml_folder_and_domains(spark, tmp_path):
    from mailspark.schema import assert_domain, domain_violations
    from mailspark.sources.raw import parse_messages, read_eml
    from mailspark.sources.tables import state_table
    from tests.corpus import SAMPLES

    inbox = tmp_path / "mail" / "INBOX"
    inbox.mkdir(parents=True)
    for i, (_, raw) in enumerate(SAMPLES[:3]):
        (inbox / f"{i + 1}.eml").write_bytes(raw)
    (inbox / "9.eml").write_bytes(b"\xff\xfe not a message \x00")
    got = rows(parse_messages(read_eml(spark, str(tmp_path / "mail"))), "uid")
    assert [(r["folder"], r["uid"]) for r in got] == [("INBOX", 1), ("INBOX", 2), ("INBOX", 3), ("INBOX", 9)]
    assert got[0]["has_ics"] and got[1]["subject"] == "云服务域名到期提醒" and got[3]["from_addr"] == ""

    odd = spark.createDataFrame([("queued",), ("lost",), (None,)], "state string")
    assert domain_violations("scheduled_pushes", odd).first()["violations"] == 1
    assert assert_domain("scheduled_pushes", odd).count() == 2
    odd.write.parquet(str(tmp_path / "q"))
    assert state_table(spark, str(tmp_path / "q"), "scheduled_pushes").where("state = 'queued'").count() == 1
