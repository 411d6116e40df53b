"""What has to stay bounded as the tables grow: tasks, batches, joins on the driver, passes over the input."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailspark.operators.rules import rule_hits
from mailspark.operators.stats import extract_stats
from mailspark.queries import all_queries
from mailspark.sources.ics import parse_ics
from mailspark.sources.raw import parse_messages, portions
from mailspark.sources.tables import spread

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_larger_inputs_get_more_parts(spark):
    assert spread(spark.range(0, 1000, 1, 4), rows=50).rdd.getNumPartitions() == 20
    assert spread(spark.range(0, 1000, 1, 30), rows=50).rdd.getNumPartitions() == 30


@pytest.mark.parametrize("name", ["hits", "ics"])
def test_costly_gates_stay_above_the_exchange(spark, name):
    """A filter on a computed text must not run a second time in the few tasks that read the input."""
    base = spark.range(100).repartition(8).select(F.col("id").alias("message_id"), F.lit("s").alias("subject"), F.concat(
        F.lit("on 2026-03-0"), F.col("id").cast("string")).alias("text"), F.current_timestamp().alias("received_at"))
    df = rule_hits(base) if name == "hits" else parse_ics(base.select("message_id", F.encode("text", "UTF-8").alias("raw")))
    below = plan(df, "simple").rsplit("REPARTITION_BY_NUM", 1)[1]
    assert "RLIKE" not in below and "regexp_replace" not in below


def test_first_whole_line_of_a_name_counts(spark):
    """Broken parameters, quoted colons, lower case, other line ends of Unicode, long parameters."""
    lines = ["BEGIN:VEVENT", 'UID;x="a:no', "uid;y=\"a:b;c\":u1", "UID:u2", "SUMMARY;p=" + "x" * 20_000 + ":a\\, b LOCATION:c",
             "DTSTART;TZID=\"Asia/Tokyo\":20260301T090000", "END:VEVENT"]
    raw = "\r\n".join(lines)
    row = parse_ics(spark.createDataFrame([(1, raw)], "message_id long, raw string")).first()
    assert (row.uid, row.summary, row.location, str(row.start_ts)) == ("u1", "a, b LOCATION:c", None, "2026-03-01 00:00:00")


@tables
def test_rows_of_every_message_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(all_queries()["raw_to_candidates"](spark, FOLDER))


def test_statistics_read_their_input_once(spark):
    verdicts = spark.range(9).select(F.col("id").alias("message_id"), F.lit(True).alias("extract"), F.lit(True).alias("call_llm"))
    found = spark.range(6).select(F.col("id").alias("message_id"), F.lit("rules").alias("source"), (F.col("id") > 2).alias("requires_review"))
    stats = extract_stats(verdicts, found)
    assert "Range" not in plan(stats)
    assert {(r.section, r.key): r.n for r in stats.collect()}[("extract", "llm_skipped")] == 6


@tables
def test_stale_results_extract_once(spark):
    assert "parquet" not in plan(all_queries()["stale_results"](spark, FOLDER)).lower()


def test_messages_are_parsed_in_small_portions(spark):
    batch = pa.record_batch([pa.array(range(7)), pa.array([b"x" * 40, None, b"y" * 200, b"", b"z" * 50, b"z" * 50, b"z"])], names=["k", "raw"])
    parts = list(portions(batch, 1, 100))
    assert [p.num_rows for p in parts] == [2, 1, 3, 1] and pa.Table.from_batches(parts).column("k").to_pylist() == list(range(7))
    raw = spark.range(50).select("id", F.encode(F.concat(F.lit("Subject: s"), F.col("id").cast("string"), F.lit("\r\n\r\nbody")), "UTF-8").alias("raw"))
    assert sorted(r.subject for r in parse_messages(raw).collect()) == sorted(f"s{i}" for i in range(50))
