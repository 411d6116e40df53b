"""Reports as files: written as ordered text, read back, and compared line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.operators import audit as au, digest as dg, evaluate as ev
from mailspark.queries.extraction import evaluated
from mailspark.queries.reporting import AUDIT_CTES, HOURS, ORACLES as LINES, audited, digest_daily
from mailspark.queries.views import CAL_EVENTS, cal_events, now, with_ctes
from mailspark.session import checkpointed, shared_path
from mailspark.sources.reports import one_text, read_text, write_text


def _filed(lines: DataFrame, name: str) -> DataFrame:
    path = shared_path(lines.sparkSession, name)
    write_text(lines, path)
    return read_text(lines.sparkSession, path)


def _digest(spark: SparkSession, folder: str) -> DataFrame:
    return dg.digest_document(checkpointed(digest_daily(spark, folder)), now(), cal_events(spark, folder))


def digest_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _filed(_digest(spark, folder), "digest")


def digest_text(spark: SparkSession, folder: str) -> DataFrame:
    return one_text(_digest(spark, folder))


def audit_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _filed(au.audit_document(checkpointed(audited(spark, folder)), now(), HOURS), "audit")


def evaluation_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    samples, found = evaluated(spark, folder)
    return _filed(ev.evaluation_document(checkpointed(samples), checkpointed(found), F.lit("2026-01-01")), "evaluation")


QUERIES = {"digest_file_lines": digest_file_lines, "digest_text": digest_text, "audit_file_lines": audit_file_lines,
           "evaluation_file_lines": evaluation_file_lines}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FRAME = ", ".join(f"({k}, {_quoted(section)}, {_quoted(shown)}, {0 if place == 'before' else 2}, {_quoted(text)})"
                   for k, (section, shown, place, text) in enumerate(lx.DIGEST_FRAME))
_DIGEST = f"""lines AS ({LINES["digest_daily"]}),
frame(ord, section, shown, key, line) AS (VALUES {_FRAME}),
ranks AS (SELECT section, row_number() OVER (ORDER BY min(ord)) AS rank FROM frame GROUP BY section),
whole AS (
  SELECT rank, key, ord, line FROM frame JOIN ranks USING (section)
   WHERE shown = 'always' OR (shown = 'filled') = (section IN (SELECT section FROM lines))
  UNION ALL SELECT rank, 1, ord, line FROM lines JOIN ranks USING (section)
  UNION ALL SELECT (SELECT rank FROM ranks WHERE section = 'pending'), 1, unnest([-2, -1]), unnest(['共 ' || n || ' 条（最多列 25 条）', ''])
    FROM (SELECT count(*) AS n FROM cal_events WHERE status = 'pending') WHERE n > 0
  UNION ALL SELECT 0, 0, unnest([0, 1, 2, 3]), unnest(['# 邮件摘要 · 1998-01-01', '', '> 生成于 1998-01-01 08:00 Asia/Shanghai', '']))"""
_REASON = """CASE WHEN auto_submitted IS NOT NULL THEN '自动投递邮件（' || auto_submitted || '）' WHEN len(noise) > 0 THEN '验证码类邮件'
  WHEN len(marketing) > 0 AND len(event) = 0 THEN '营销/推广类邮件（命中 ' || array_to_string(marketing[1:3], ', ') || '）'
  WHEN is_list AND len(event) = 0 THEN '群发列表邮件且无事件线索' WHEN len(event) = 0 AND NOT paired THEN '未发现事件线索（无事件关键词，也无同段的日期+时刻）'
  ELSE '含事件线索' || CASE WHEN len(event) = 0 THEN '' ELSE '（关键词：' || array_to_string(event[1:3], ', ') || '）' END
    || CASE WHEN len(event) = 0 OR paired THEN '；同段内日期与时刻配对完整，规则应能覆盖'
       WHEN has_date AND has_time THEN '；日期与时刻分处不同段落，规则无法配对，值得 LLM 兜底' ELSE '；时间形态不完整，值得 LLM 兜底' END END"""
_AUDIT = f"""shown AS (SELECT t.*, v.subject, v.from_addr, v.received_at, {_REASON} AS why,
  t.kind = 'yes' AS wanted, trim(regexp_replace(v.body_excerpt, '\\s+', ' ', 'g')) AS head,
  lpad(CAST(t.message_id AS VARCHAR), 20, '0') AS key FROM told t JOIN verdicts v ON v.id = t.message_id),
n AS (SELECT count(*) AS messages, count(*) FILTER (level = 2) AS likely, count(*) FILTER (level = 1) AS maybe, count(*) FILTER (candidates > 0) AS with_candidates,
  count(*) FILTER (missing > 0) AS stale, count(*) FILTER (call_llm AND candidates = 0) AS unjudged, count(*) FILTER (level > 0) AS suspect,
  count(*) FILTER (level = 0 AND candidates > 0) AS found, count(*) FILTER (level = 0 AND candidates = 0) AS quiet FROM shown),
listed AS (
  SELECT 0 AS rank, '' AS key, ['# 抽取复盘 · 1998-01-01', '', '窗口：最近 {HOURS} 小时（' || strftime(TIMESTAMP '1998-01-01 08:00:00' - to_hours({HOURS}), '%Y-%m-%d %H:%M')
    || ' → 1998-01-01 08:00 Asia/Shanghai）', '邮件 ' || messages || ' 封 ｜ 很可能漏抽 ' || likely || ' ｜ 值得留意 ' || maybe || ' ｜ 已抽出 ' || with_candidates
    || ' ｜ 库中结果过时 ' || stale || CASE WHEN unjudged > 0 THEN ' ｜ 未判定 ' || unjudged ELSE '' END] AS rows FROM n
  UNION ALL SELECT 1, '', ['', '### 未判定（' || unjudged || ' 封，需 LLM 才能判断）', ''] FROM n WHERE unjudged > 0
  UNION ALL SELECT 1, key, ['- `#' || message_id || '` ' || subject || ' — ' || why] FROM shown WHERE call_llm AND candidates = 0
  UNION ALL SELECT 2, '', ['', '## 需要你看一眼（' || suspect || ' 封）', ''] || CASE WHEN suspect = 0 THEN ['没有可疑项。'] ELSE [] END FROM n
  UNION ALL SELECT 3, '', ['', '## 已抽出候选（' || found || ' 封）', ''] || CASE WHEN found = 0 THEN ['无。'] ELSE [] END FROM n
  UNION ALL SELECT 4, '', ['', '## 其余（' || quiet || ' 封，未抽出且无明显线索）', ''] FROM n
  UNION ALL SELECT CASE WHEN level > 0 THEN 2 WHEN candidates > 0 THEN 3 ELSE 4 END, key,
    CASE WHEN level = 0 AND candidates = 0 THEN ['- `#' || message_id || '` ' || subject || ' — ' || why]
    ELSE ['### `#' || message_id || '` ' || subject || CASE level WHEN 2 THEN ' **[很可能漏抽]**' WHEN 1 THEN ' **[值得留意]**' ELSE '' END,
      '- 收到：' || strftime(received_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' ｜ 发件人：' || from_addr,
      '- 预筛：' || CASE WHEN wanted THEN '值得抽取' ELSE '过滤' END || '（' || why || '）', '- 当前候选：' || candidates || ' ｜ 库中事件：' || stored]
      || CASE WHEN level > 0 THEN ['- ⚠️ ' || suspicion, '  正文开头：' || head] ELSE [] END END FROM shown)"""

_NUMBERED = "SELECT {date} AS report_date, row_number() OVER (ORDER BY rank, key, ord, line) AS line_no, line FROM {rows}"
_UNFOLDED = "(SELECT rank, key, unnest(range(len(rows))) AS ord, unnest(rows) AS line FROM listed)"
_SAMPLES = """s AS (SELECT CAST(d.doc_id AS VARCHAR) AS name, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS hit, n_chars % 2 = 1 AS auto,
  '[' || source || '] ' || strftime(DATE '2026-01-01' + CAST(d.doc_id % 300 AS INTEGER), '%Y-%m-%d') || ' 08:00  doc' AS told
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT count(*) AS mails, sum(hit) AS hits, count(*) FILTER (auto) AS pushed, coalesce(sum(hit) FILTER (auto), 0) AS good FROM s),
r AS (SELECT *, CASE WHEN mails > 0 THEN hits / mails ELSE 1 END AS p, CASE WHEN pushed > 0 THEN good / pushed ELSE 1 END AS a FROM t),
listed AS (
  SELECT 0 AS rank, '' AS key, ['# 抽取质量评估报告', '', '## 总体指标', '', '| 指标 | 值 | 说明 |', '|---|---|---|',
    '| 召回率 | **100.0%** | 真值事件被抽出的比例（漏识别） |', '| 精确率 | **' || printf('%.1f', round(p * 100, 1)) || '%** | 候选中命中真值的比例（误报） |',
    '| F1 | **' || printf('%.3f', round(2 * p / (p + 1), 3)) || '** | 召回与精确的调和平均 |',
    '| 自动入历准确率 | **' || printf('%.1f', round(a * 100, 1)) || '%** | ' || good || '/' || pushed || ' —— 最关键指标 |', '', '## 计数', '',
    '- 语料邮件数：' || mails, '- 真值事件数：' || hits, '- 抽出候选数：' || mails, '- 正确匹配：' || hits, '- 可自动入历：' || pushed, ''] AS rows FROM r
  UNION ALL SELECT k, '', [h, ''] FROM (VALUES (1, '## ⚠️ 误报：本不该抽出事件的邮件'), (3, '## 多余候选（已在误报中列出，此处按事件展开）'),
    (4, '## 🚨 危险的自动入历（会污染日历）')) AS v(k, h) WHERE EXISTS (SELECT 1 FROM s WHERE hit = 0 AND (k < 4 OR auto))
  UNION ALL SELECT k, '\U0010ffff', [''] FROM (VALUES (1), (3), (4)) AS v(k) WHERE EXISTS (SELECT 1 FROM s WHERE hit = 0 AND (k < 4 OR auto))
  UNION ALL SELECT k, name, ['- `' || name || '`：' || told] FROM s, (VALUES (1), (3), (4)) AS v(k) WHERE hit = 0 AND (k < 4 OR auto)
  UNION ALL SELECT 5, '', ['## 逐样本明细', '', '| 样本 | 真值 | 候选 | 匹配 | 自动入历 | 待审 |', '|---|---:|---:|---:|---:|---:|']
  UNION ALL SELECT 5, name, ['| `' || name || '` | ' || hit || ' | 1 | ' || hit || ' | ' || CASE WHEN auto THEN '1 | 0' ELSE '0 | 1' END || ' |'] FROM s)"""

_DAY = "'1998-01-01'"
ORACLES = {
    "digest_file_lines": with_ctes(_NUMBERED.format(date=_DAY, rows="whole"), CAL_EVENTS, _DIGEST),
    "digest_text": with_ctes(f"SELECT {_DAY} AS report_date, string_agg(line, chr(10) ORDER BY rank, key, ord, line) AS text FROM whole",
                             CAL_EVENTS, _DIGEST),
    "audit_file_lines": with_ctes(_NUMBERED.format(date=_DAY, rows=_UNFOLDED), *AUDIT_CTES, _AUDIT),
    "evaluation_file_lines": with_ctes(_NUMBERED.format(date="'2026-01-01'", rows=_UNFOLDED), _SAMPLES),
}
