"""Reports as ordered text files, and the documents made for them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailspark.operators import audit as au, digest as dg, evaluate as ev
from mailspark.sources.reports import one_text, read_text, write_text
from tests.conftest import rows

LINES = "report_date string, rank int, key string, ord long, line string"


def back(spark, path):
    return [(r["report_date"], r["line_no"], r["line"]) for r in rows(read_text(spark, path), "report_date", "line_no")]


@pytest.fixture
def many_tasks(spark):
    """Ranges of lines stay as many tasks as there are partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_a_report_of_many_files_reads_back_in_order(spark, tmp_path, many_tasks):
    path = str(tmp_path / "r")
    lines = spark.range(3000).select(
        F.lit("2026-01-01").alias("report_date"), (F.col("id") % 3).cast("int").alias("rank"), F.lit("k").alias("key"),
        F.col("id").alias("ord"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    write_text(lines.repartition(5), path)
    assert len(list((tmp_path / "r" / "report_date=2026-01-01").glob("part-*"))) > 1
    want = [f"line {i}" for rank in range(3) for i in range(rank, 3000, 3)]
    assert back(spark, path) == [("2026-01-01", k, line) for k, line in enumerate(want, 1)]


def test_a_later_report_replaces_its_own_dates_only(spark, tmp_path):
    path = str(tmp_path / "r")
    for day, texts in (("2026-01-01", ["old", "older", "oldest"]), ("2026-01-02", ["two"]), ("2026-01-01", ["new"])):
        write_text(spark.createDataFrame([(day, 0, "", k, t) for k, t in enumerate(texts)], LINES), path)
    assert back(spark, path) == [("2026-01-01", 1, "new"), ("2026-01-02", 1, "two")]


def test_every_row_is_one_line(spark, tmp_path):
    path = str(tmp_path / "r")
    lines = spark.createDataFrame([("d", 0, "", 0, "a\nb\r"), ("d", 0, "", 1, None), ("d", 0, "", 2, ""), ("d", 0, "", 3, "é 漢"),
                                   ("d", 0, "", 3, "é 漢")], LINES)
    write_text(lines, path)
    assert back(spark, path) == [("d", 1, "a b "), ("d", 2, ""), ("d", 3, ""), ("d", 4, "é 漢"), ("d", 5, "é 漢")]
    assert one_text(lines).first()["text"] == "a\nb\r\n\n\né 漢\né 漢"


def test_digest_without_anything_says_so(spark):
    lines = spark.createDataFrame([], "digest_date string, section string, ord long, line string")
    events = spark.createDataFrame([], "status string")
    at = F.lit(datetime(2026, 1, 1, 20)).cast("timestamp")
    text = one_text(dg.digest_document(lines, at, events)).first()
    assert text["report_date"] == "2026-01-02"  # the local day
    assert text["text"].splitlines() == [
        "# 邮件摘要 · 2026-01-02", "", "> 生成于 2026-01-02 04:00 Asia/Shanghai", "", "## 日历", "", "**今天**：无安排", "",
        "## 待审事件", "", "无。", "", "## 近期邮件", "", "无。", "", "## 系统状态", ""]


def test_audit_of_nothing_says_so(spark):
    items = spark.createDataFrame([], """message_id long, subject string, from_addr string, received_at timestamp, extract boolean,
        call_llm boolean, llm_called boolean, candidates long, missing long, stored long, level int, prefilter_reason string,
        suspicion string, head string""")
    at = F.lit(datetime(2026, 1, 2)).cast("timestamp")
    text = one_text(au.audit_document(items, at, 24)).first()["text"].split("\n")
    assert text == ["# 抽取复盘 · 2026-01-02", "", "窗口：最近 24 小时（2026-01-01 08:00 → 2026-01-02 08:00 Asia/Shanghai）",
                    "邮件 0 封 ｜ 很可能漏抽 0 ｜ 值得留意 0 ｜ 已抽出 0 ｜ 库中结果过时 0", "", "## 需要你看一眼（0 封）", "", "没有可疑项。",
                    "", "## 已抽出候选（0 封）", "", "无。", "", "## 其余（0 封，未抽出且无明显线索）", ""]


def test_evaluation_names_each_kind_of_finding_once(spark):
    samples = spark.createDataFrame([("a", 2, 1, 1, 1, 1, 0), ("b", 0, 1, 0, 1, 0, 0)],
                                    "name string, expected long, candidates long, matched long, auto_push long, auto_push_correct long, review long")
    found = spark.createDataFrame([("a", "missed", "x"), ("b", "false_positive", "y"), ("b", "spurious", "y"),
                                   ("b", "auto_push_wrong", None)], "name string, finding string, detail string")
    text = one_text(ev.evaluation_document(samples, found, F.lit("2026-01-01"))).first()["text"].split("\n")
    assert "| 召回率 | **50.0%** | 真值事件被抽出的比例（漏识别） |" in text and "| F1 | **0.500** | 召回与精确的调和平均 |" in text
    assert [t for t in text if t.startswith("- `")] == ["- `b`：y", "- `a`：x", "- `b`：y", "- `b`："]
    assert text[-2:] == ["| `a` | 2 | 1 | 1 | 1 | 0 |", "| `b` | 0 | 1 | 0 | 1 | 0 |"]
    assert sum(t.startswith("## ") for t in text) == 7
