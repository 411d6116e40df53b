"""The labelled corpus end to end: raw bytes to candidates to metrics."""

from datetime import datetime

from pyspark.sql import Window, functions as F

from mailspark.operators import evaluate
from mailspark.operators.candidates import extract
from mailspark.sources.ics import parse_ics
from mailspark.sources.raw import parse_messages
from tests.conftest import rows
from tests.corpus import EXPECTED, EXPECTED_SCHEMA, RECEIVED, SAMPLES


def corpus_candidates(spark, partitions=3):
    raw = spark.createDataFrame([(i, n, bytearray(b)) for i, (n, b) in enumerate(SAMPLES)],
                                "message_id long, name string, raw binary").repartition(partitions)
    parsed = parse_messages(raw)
    messages = parsed.select(
        "message_id", "name", "subject", F.col("body_excerpt").alias("text"), F.lit(RECEIVED).alias("received_at"),
        "auto_submitted", "is_list", (F.size("ics_parts") > 0).alias("has_ics"), "from_addr")
    parts = parsed.select("message_id", F.explode("ics_parts").alias("p")).select("message_id", "p.raw")
    now = F.lit(datetime(2026, 9, 14, 2, 0))
    verdicts, found = extract(messages, now, vevents=parse_ics(parts))
    order = Window.partitionBy("message_id").orderBy("start_ts", "title")
    return messages, found.join(messages.select("message_id", "name"), "message_id").withColumn(
        "cand_ord", F.row_number().over(order) - 1)


def test_metrics_of_the_corpus(spark):
    messages, found = corpus_candidates(spark)
    expected = spark.createDataFrame(EXPECTED, EXPECTED_SCHEMA)
    matches = evaluate.match_truth(found, expected)
    samples = evaluate.per_sample(messages, found, expected, matches)
    total = evaluate.metrics(samples).first().asDict()
    details = rows(evaluate.findings(found, expected, matches), "name")
    assert details == []
    assert (total["expected"], total["candidates"], total["matched"]) == (12, 12, 12)
    assert total["recall"] == total["precision"] == total["f1"] == 1.0
    assert (total["auto_push"], total["auto_push_correct"]) == (8, 8)


def test_titles_and_reviews(spark):
    _, found = corpus_candidates(spark, 1)
    by_name = {r["name"]: r for r in rows(found)}
    assert by_name["flight"]["title"] == "航班 CX368 从香港国际机场起飞"
    assert by_name["no_year"]["requires_review"] and "无年份" in by_name["no_year"]["review_reason"]
    assert by_name["past_minutes"]["review_reason"].startswith("时间已过")
    assert by_name["ics_invite"]["confidence"] == 0.99
    assert by_name["quoted_date"]["title"] == "Re: 会议安排" or "会议" in by_name["quoted_date"]["title"]
