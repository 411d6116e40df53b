"""Extraction queries: prefilter, rule hits, confidence and gates, merge, conflicts, model responses, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import flag, iso_utc
from mailspark.functions.dates import infer_year, weekday_date
from mailspark.operators import candidates as cd, evaluate as ev
from mailspark.operators.prefilter import classify
from mailspark.operators.rules import rule_candidates, rule_hits
from mailspark.operators.stats import extract_stats
from mailspark.queries.views import MAIL_ORDERS, NOW, mail_orders, now, sql_any, sql_list, with_ctes
from mailspark.sources.tables import load


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return mail_orders(spark, folder).withColumnsRenamed({"id": "message_id", "body_excerpt": "text"})


def prefilter_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    judged = classify(mail_orders(spark, folder))
    v = "verdict."
    return judged.select("id", flag(F.col(v + "extract")).alias("extract"), flag(F.col(v + "call_llm")).alias("call_llm"),
                         F.col(v + "score").cast("long").alias("score"),
                         F.array_join(v + "matched", ",").alias("matched"))


def rule_hits_iso(spark: SparkSession, folder: str) -> DataFrame:
    hits = rule_hits(_messages(spark, folder))
    return hits.select(
        "message_id", iso_utc(F.col("start_ts")).alias("start_ts"), F.coalesce(iso_utc(F.col("end_ts")), F.lit("")).alias(
            "end_ts"), flag(F.col("all_day")).alias("all_day"), flag(F.col("has_time")).alias("has_time"), "evidence",
        flag(F.col("vague")).alias("vague"), flag(F.col("ambiguous")).alias("ambiguous"))


def year_inference(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    dated = load(spark, folder, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("date").alias("received"), (k % 12 + 1).cast("int").alias("m"),
        (k % 31 + 1).cast("int").alias("d"))
    found = infer_year(F.col("m"), F.col("d"), F.col("received"))
    return dated.select("id", F.coalesce(found.cast("string"), F.lit("none")).alias("day"))


def relative_weekday(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    scope = F.when(k % 3 == 0, "下").when(k % 3 == 1, "本").otherwise("")
    digit = F.element_at(F.array(*[F.lit(c) for c in "一二三四五六日"]), (k % 7 + 1).cast("int"))
    rows = load(spark, folder, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("date").alias("received"), scope.alias("scope"), digit.alias("digit"))
    return rows.select("id", weekday_date(F.col("digit"), F.col("scope"), F.col("received")).cast("string").alias("day"))


def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    scored = rule_candidates(rule_hits(_messages(spark, folder)), now())
    return scored.select("message_id", iso_utc(F.col("start_ts")).alias("start_ts"), "confidence",
                         flag(F.col("requires_review")).alias("requires_review"), "review_reason")


def review_reasons_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: messages to verdicts to scored, gated, merged candidates, counted per local month and reason."""
    _, found = cd.extract(_messages(spark, folder), now())
    month = F.date_format(F.from_utc_timestamp("start_ts", "Asia/Shanghai"), "yyyy-MM")
    return found.groupBy(month.alias("month"), "source", "review_reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence_sum"))


def extract_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What a run over all orders found: verdicts, candidates, and messages that a model could still have read."""
    verdicts, found = cd.extract(_messages(spark, folder), now())
    return extract_stats(verdicts, found).select("section", "key", "n")


def _candidate_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Three candidate sets over the orders whose slots overlap: calendar entries, rules and model answers."""
    k = F.col("o_orderkey")
    base = load(spark, folder, "orders").select(k.alias("k"), "o_orderdate", F.floor(k / 4).alias("message_id"))
    k = F.col("k")
    none = F.lit(None).cast("string")
    source = F.when(k % 3 == 0, "ics").when(k % 3 == 1, "rules").otherwise("llm")
    start = (F.to_timestamp(F.date_format(F.date_add(F.lit("2026-01-01"), (F.col("message_id") % 300).cast("int")),
                                          "yyyy-MM-dd")) + F.make_dt_interval(
        hours=(k % 2 * 2).cast("int"), mins=(k % 5 / 4).cast("int") * 30))
    return base.select(
        "message_id", (k % 4).cast("int").alias("ord"),
        F.concat(F.lit("Title "), (k % 3).cast("string")).alias("title"), start.alias("start_ts"), start.alias("end_ts"),
        (k % 11 == 0).alias("all_day"), source.alias("source"), F.lit(0.9).alias("confidence"),
        F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), F.concat(F.lit("ev"), k.cast("string")).alias(
            "evidence"), none.alias("location"), none.alias("organizer"), none.alias("tz"), none.alias("ics_uid"),
        F.lit(None).cast("int").alias("ics_sequence"), none.alias("ics_recurrence_id"), none.alias("ics_rrule"),
        (source == "llm").alias("requires_review"), F.when(source == "llm", lx.GATE_LLM).otherwise("").alias(
            "review_reason"), (k % 6 == 1).alias("title_from_subject"))


def slot_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    kept = cd.dedupe_slots(_candidate_sets(spark, folder))
    return kept.select("message_id", iso_utc(F.col("start_ts")).alias("start_ts"), flag(F.col("all_day")).alias("all_day"),
                       "source", "fingerprint", flag(F.col("requires_review")).alias("requires_review"))


def conflict_marks(spark: SparkSession, folder: str) -> DataFrame:
    marked = cd.mark_conflicts(cd.dedupe_slots(_candidate_sets(spark, folder)))
    return marked.select("message_id", "fingerprint", F.array_join("conflicts_with", ",").alias("conflicts_with"),
                         flag(F.col("requires_review")).alias("requires_review"))


def merged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Titles lent and notes left by displaced candidates."""
    kept = cd.dedupe_slots(_candidate_sets(spark, folder))
    return kept.select("message_id", "fingerprint", "title", "evidence", "review_reason")


def outcome_summary(spark: SparkSession, folder: str) -> DataFrame:
    return cd.outcome_summary(cd.dedupe_slots(_candidate_sets(spark, folder)))


def llm_response_normalise(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    item = F.when(e % 4 == 0, F.concat(F.lit('{"title":"t'), e.cast("string"), F.lit('","start":"'), stamp, F.lit('+08:00","confidence":0.7}'))).when(
        e % 4 == 1, F.concat(F.lit('{"title":"","start":"'), stamp, F.lit('","all_day":true,"evidence":"k'), k.cast("string"), F.lit('"}'))).when(
        e % 4 == 2, F.lit('{"title":"no start","start":""}')).otherwise(
        F.concat(F.lit('{"title":"bad","start":"'), stamp, F.lit('Z","confidence":7}')))
    body = F.concat(F.lit('{"events":['), item, F.lit("]}"))
    text = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        e % 3 == 1, F.concat(F.lit("Sure, here it is: "), body)).otherwise(body)
    responses = load(spark, folder, "events").select(e.alias("message_id"), text.alias("response"))
    return cd.llm_candidates(responses).select(
        "message_id", "title", iso_utc(F.col("start_ts")).alias("start_ts"),
        F.coalesce(iso_utc(F.col("end_ts")), F.lit("")).alias("end_ts"), flag(F.col("all_day")).alias("all_day"),
        "confidence", "evidence", flag(F.col("requires_review")).alias("requires_review"))


def ics_gate(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    entries = load(spark, folder, "orders").select(
        k.alias("message_id"), F.lit(0).alias("ord"), F.concat(F.lit("s"), k.cast("string")).alias("summary"),
        F.when(k % 6 != 0, F.col("o_orderdate")).alias("start_ts"), F.col("o_orderdate").alias("end_ts"),
        F.lit(False).alias("all_day"), F.lit("x").alias("fingerprint"), F.lit("e").alias("evidence"),
        none.alias("location"), F.when(k % 5 != 0, "o@x").alias("organizer"), F.lit("u").alias("uid"),
        F.lit(0).alias("sequence"), none.alias("recurrence_id"), none.alias("rrule"),
        F.when(k % 4 == 1, "CANCEL").when(k % 4 == 2, "REPLY").when(k % 4 == 3, "REQUEST").alias("method"),
        (k % 4 == 1).alias("is_cancellation"), (k % 7 != 0).alias("is_known_contact"))
    return cd.ics_candidates(entries, now()).select(
        "message_id", "confidence", flag(F.col("requires_review")).alias("requires_review"), "review_reason")


def evaluated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Counts by sample and findings: every document as a candidate, the labels as truth, matched where a document is
    of good quality."""
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    name = F.col("doc_id").cast("string")
    base = F.date_add(F.lit("2026-01-01"), (F.col("doc_id") % 300).cast("int"))
    cand = docs.select(
        name.alias("name"), F.lit(0).cast("long").alias("cand_ord"), "source", F.lit("doc").alias("title"),
        F.lit("").alias("evidence"), F.to_timestamp(F.date_format(base, "yyyy-MM-dd")).alias("start_ts"),
        F.lit(False).alias("all_day"), (F.col("n_chars") % 2 == 0).alias("requires_review"))
    truth = labels.where("quality = 1").select(
        name.alias("name"), F.lit(0).cast("long").alias("exp_ord"), F.lit("DOC").alias("title_contains"),
        base.alias("start_date"), F.lit("08:10").alias("start_time"), F.lit(15).alias("tolerance_minutes"),
        F.lit("meeting").alias("kind"))
    matches = ev.match_truth(cand, truth)
    return ev.per_sample(docs.select(name.alias("name")), cand, truth, matches), ev.findings(cand, truth, matches)


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return ev.metrics(evaluated(spark, folder)[0]).select(
        "expected", "candidates", "matched", "auto_push", "auto_push_correct", F.round("recall", 6).alias("recall"),
        F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"),
        F.round("auto_push_accuracy", 6).alias("auto_push_accuracy"))


def greedy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as candidates of a customer group and day, purchases as truth: many of either in a day, with close hours."""
    k = F.col("o_orderkey")
    day = lambda c: F.date_add(F.lit("2026-01-01"), (c % 5).cast("int"))
    orders = load(spark, folder, "orders")
    cand = orders.select(
        (F.col("o_custkey") % 40).cast("string").alias("name"), k.alias("cand_ord"), F.concat(F.lit("Call "), (k % 3).cast("string")).alias("title"),
        F.lit(None).cast("string").alias("evidence"),
        (F.to_timestamp(F.date_format(day(F.col("o_custkey")), "yyyy-MM-dd")) + F.make_dt_interval(mins=(k % 720).cast("int"))).alias("start_ts"))
    e = F.col("event_id")
    truth = load(spark, folder, "events").where("event_type = 'purchase'").select(
        (F.col("user_id") % 40).cast("string").alias("name"), e.alias("exp_ord"), F.concat(F.lit("CALL "), (e % 3).cast("string")).alias("title_contains"),
        day(F.col("user_id")).alias("start_date"), F.date_format(F.timestamp_seconds(F.lit(28800) + (e * 7 % 720) * 60), "HH:mm").alias("start_time"),
        F.lit(45).alias("tolerance_minutes"))
    return ev.match_truth(cand, truth)


QUERIES = {
    "prefilter_verdicts": prefilter_verdicts, "rule_hits_iso": rule_hits_iso, "year_inference": year_inference,
    "relative_weekday": relative_weekday, "confidence_gate": confidence_gate,
    "review_reasons_daily": review_reasons_daily, "slot_dedupe": slot_dedupe, "conflict_marks": conflict_marks,
    "merged_evidence": merged_evidence, "outcome_summary": outcome_summary, "extract_statistics": extract_statistics,
    "llm_response_normalise": llm_response_normalise, "ics_gate": ics_gate, "eval_metrics": eval_metrics,
    "greedy_matches": greedy_matches,
}

_P = r"string_split_regex(body_excerpt, '\n\s*\n')"
_DATE, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{1,2}:\d{2}"

VERDICTS = rf"""verdicts AS (
SELECT *, CASE
    WHEN has_ics THEN 'ics' WHEN auto_submitted IS NOT NULL THEN 'machine' WHEN len(noise) > 0 THEN 'noise'
    WHEN len(marketing) > 0 AND len(event) = 0 THEN 'marketing' WHEN is_list AND len(event) = 0 THEN 'list'
    WHEN len(event) = 0 AND NOT paired THEN 'none' ELSE 'yes' END AS kind
FROM (SELECT *,
    list_filter({sql_list(lx.NOISE_KEYWORDS)}, lambda w: contains(hay, w)) AS noise,
    list_filter({sql_list(lx.EVENT_KEYWORDS)}, lambda w: contains(hay, w)) AS event,
    list_filter({sql_list(lx.MARKETING_KEYWORDS)}, lambda w: contains(hay, w)) AS marketing,
    regexp_matches(body_excerpt, '{_DATE}') AS has_date, regexp_matches(body_excerpt, '{_TIME}') AS has_time,
    len(list_filter({_P}, lambda p: regexp_matches(p, '{_DATE}') AND regexp_matches(p, '{_TIME}'))) > 0 AS paired
  FROM (SELECT *, lower(subject || chr(10) || body_excerpt) AS hay FROM mail_orders)))"""

HITS = rf"""hit_rows AS (
SELECT id AS message_id, received_at, is_deadline, p_ord, i AS d_ord, p, ds[i] AS d, ts[i] AS t, len(ds) AS n_dates
FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM (
  SELECT *, regexp_extract_all(p, '{_DATE}') AS ds, list_filter(regexp_extract_all(p, '{_TIME}'), lambda x, i: list_position(regexp_extract_all(p, '{_TIME}'), x) = i) AS ts
  FROM (SELECT *, ps[p_ord] AS p FROM (
    SELECT id, received_at, {sql_any('lower(subject || chr(10) || body_excerpt)', lx.DEADLINE_KEYWORDS)} AS is_deadline,
      {_P} AS ps, unnest(range(1, len({_P}) + 1)) AS p_ord FROM src)
  ) WHERE NOT ({sql_any('lower(p)', lx.DISCLAIMER_HINTS)} AND length(p) < 200)))),
hits AS (
SELECT *, strptime(d || ' ' || coalesce(t, '00:00'), '%Y-%m-%d %H:%M') - INTERVAL 8 HOUR AS start_ts,
  t IS NOT NULL AS has_time, d || coalesce(' + ' || t, '') AS evidence, {sql_any('p', lx.VAGUE_WORDS)} AS vague,
  count(*) OVER (PARTITION BY message_id) > 1 AND max(n_dates) OVER (PARTITION BY message_id) > 1 AS ambiguous
FROM (SELECT *, row_number() OVER (PARTITION BY message_id, d, t ORDER BY p_ord, d_ord) AS rn FROM hit_rows) WHERE rn = 1)"""

SCORED = f"""scored AS (
SELECT *, CASE WHEN start_ts < TIMESTAMP '{NOW}' THEN '{lx.GATE_PAST}' WHEN ambiguous THEN '{lx.GATE_AMBIGUOUS}'
   WHEN vague THEN '{lx.GATE_VAGUE}' WHEN start_ts < received_at THEN '{lx.GATE_BEFORE_RECEIVED}'
   WHEN confidence <= 0.85 THEN '{lx.GATE_THRESHOLD[0]}' || CAST(confidence AS VARCHAR) || '{lx.GATE_THRESHOLD[1]}'
   ELSE '' END AS review_reason
FROM (SELECT *, round(CAST((CASE WHEN has_time THEN 0.95 ELSE 0.85 END) * (CASE WHEN ambiguous THEN 0.8 ELSE 1.0 END)
    * (CASE WHEN vague THEN 0.6 ELSE 1.0 END) AS DOUBLE), 4) AS confidence FROM hits))"""

_ALL = "src AS (SELECT * FROM mail_orders)"
_OPEN = "src AS (SELECT * FROM verdicts WHERE kind IN ('ics', 'yes'))"

SETS = """sets AS (
SELECT *, start_ts + INTERVAL 8 HOUR AS local_ts, CASE source WHEN 'ics' THEN 1 WHEN 'rules' THEN 2 ELSE 3 END AS rank FROM (
SELECT k // 4 AS message_id, k % 4 AS ord, 'Title ' || (k % 3) AS title,
  CAST(DATE '2026-01-01' + CAST((k // 4) % 300 AS INTEGER) AS TIMESTAMP) + to_hours(k % 2 * 2) + to_minutes((k % 5 // 4) * 30) AS start_ts,
  k % 11 = 0 AS all_day, CASE k % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'rules' ELSE 'llm' END AS source,
  'f' || k AS fingerprint, k % 3 = 2 AS review, 'ev' || k AS evidence, k % 6 = 1 AS generic
FROM (SELECT o_orderkey AS k FROM orders))),
kept AS (SELECT *, CASE WHEN all_day THEN 'allday' ELSE strftime(local_ts, '%H:%M') END AS slot FROM (
  SELECT *, bool_or(NOT all_day) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS day_timed FROM sets)
  WHERE NOT (all_day AND day_timed)),
winners AS (SELECT *, bool_or(review) OVER (PARTITION BY message_id, CAST(local_ts AS DATE), slot) AS any_review,
  row_number() OVER (PARTITION BY message_id, CAST(local_ts AS DATE), slot ORDER BY rank, ord) AS rn FROM kept)"""

ORACLES = {
    "prefilter_verdicts": with_ctes("""
SELECT id, CASE WHEN kind IN ('ics', 'yes') THEN 1 ELSE 0 END AS extract,
  CASE WHEN kind = 'yes' AND len(event) > 0 AND NOT paired THEN 1 ELSE 0 END AS call_llm,
  CASE kind WHEN 'ics' THEN 100 WHEN 'machine' THEN -50 WHEN 'noise' THEN -40 WHEN 'marketing' THEN -20 WHEN 'list' THEN -10
    ELSE len(event) * 3 + CASE WHEN has_date THEN 2 ELSE 0 END + CASE WHEN has_time THEN 3 ELSE 0 END END AS score,
  CASE kind WHEN 'ics' THEN 'ics' WHEN 'noise' THEN array_to_string(noise, ',') WHEN 'marketing' THEN array_to_string(marketing, ',')
    WHEN 'yes' THEN array_to_string(list_filter(event, lambda w, i: list_position(event, w) = i), ',')
    ELSE '' END AS matched FROM verdicts""", MAIL_ORDERS, VERDICTS),
    "rule_hits_iso": with_ctes("""
SELECT message_id, strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') AS start_ts,
  CASE WHEN is_deadline THEN '' ELSE strftime(start_ts + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS end_ts,
  CASE WHEN is_deadline OR NOT has_time THEN 1 ELSE 0 END AS all_day, CASE WHEN has_time THEN 1 ELSE 0 END AS has_time,
  evidence, CASE WHEN vague THEN 1 ELSE 0 END AS vague, CASE WHEN ambiguous THEN 1 ELSE 0 END AS ambiguous
FROM hits""", MAIL_ORDERS, _ALL, HITS),
    "year_inference": """
WITH a AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS r, o_orderkey % 12 + 1 AS m, o_orderkey % 31 + 1 AS d FROM orders),
b AS (SELECT *, try_cast(printf('%04d-%02d-%02d', year(r), m, d) AS DATE) AS y0, try_cast(printf('%04d-%02d-%02d', year(r) + 1, m, d) AS DATE) AS y1 FROM a)
SELECT id, coalesce(CAST(CASE WHEN y0 >= r - 30 THEN y0 WHEN y0 IS NOT NULL THEN y1 END AS VARCHAR), 'none') AS day FROM b""",
    "relative_weekday": """
WITH a AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS r, o_orderkey % 3 AS s,
  (o_orderkey % 7 - (isodow(o_orderdate) - 1) + 7) % 7 AS ahead FROM orders)
SELECT id, CAST(r + CAST(CASE WHEN s = 0 THEN ahead + 7 WHEN s = 1 THEN ahead WHEN ahead = 0 THEN 7 ELSE ahead END AS INTEGER) AS VARCHAR) AS day FROM a""",
    "confidence_gate": with_ctes("""
SELECT message_id, strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, confidence,
  CASE WHEN review_reason = '' THEN 0 ELSE 1 END AS requires_review, review_reason FROM scored""",
                                 MAIL_ORDERS, _ALL, HITS, SCORED),
    "review_reasons_daily": with_ctes(f"""
, days AS (SELECT *, is_deadline OR NOT has_time AS all_day, start_ts + INTERVAL 8 HOUR AS local_ts FROM scored),
kept AS (SELECT * FROM (SELECT *, bool_or(NOT all_day) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS day_timed FROM days)
  WHERE NOT (all_day AND day_timed)),
marked AS (SELECT *, list(start_ts) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS peers FROM kept)
SELECT month, source, review_reason, count(*) AS n, round(sum(confidence), 4) AS confidence_sum FROM (
  SELECT strftime(local_ts, '%Y-%m') AS month, 'rules' AS source, confidence,
    CASE WHEN len(list_filter(peers, lambda p: abs(epoch(p) - epoch(start_ts)) > 3600)) = 0 THEN review_reason
      WHEN review_reason = '' THEN '{lx.CONFLICT_REASON}' ELSE review_reason || '；{lx.CONFLICT_REASON}' END AS review_reason
  FROM marked) GROUP BY ALL""".lstrip(), MAIL_ORDERS, VERDICTS, _OPEN, HITS, SCORED).replace("\n, days AS", ",\ndays AS"),
    "extract_statistics": with_ctes("""
, days AS (SELECT *, is_deadline OR NOT has_time AS all_day, start_ts + INTERVAL 8 HOUR AS local_ts FROM scored),
kept AS (SELECT * FROM (SELECT *, bool_or(NOT all_day) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS day_timed FROM days)
  WHERE NOT (all_day AND day_timed)),
marked AS (SELECT *, list(start_ts) OVER (PARTITION BY message_id, CAST(local_ts AS DATE)) AS peers FROM kept),
made AS (SELECT message_id, review_reason <> '' OR len(list_filter(peers, lambda p: abs(epoch(p) - epoch(start_ts)) > 3600)) > 0 AS waits FROM marked),
m AS (SELECT count(*) AS considered, count(*) FILTER (kind NOT IN ('ics', 'yes')) AS skipped_by_prefilter,
  count(*) FILTER (kind = 'yes' AND len(event) > 0 AND NOT paired) AS call_llm FROM verdicts),
c AS (SELECT count(*) AS total, count(DISTINCT message_id) AS with_candidates, count(*) FILTER (waits) AS requires_review,
  count(*) FILTER (NOT waits) AS auto_pushable FROM made),
x AS (SELECT 0::BIGINT AS llm_called, count(*) AS llm_skipped FROM verdicts WHERE kind = 'yes' AND len(event) > 0 AND NOT paired
  AND id NOT IN (SELECT message_id FROM made WHERE NOT waits))
SELECT 'messages' AS section, name AS key, value AS n FROM (UNPIVOT m ON considered, skipped_by_prefilter, call_llm)
UNION ALL SELECT 'candidates', name, value FROM (UNPIVOT c ON total, with_candidates, requires_review, auto_pushable)
UNION ALL SELECT 'extract', name, value FROM (UNPIVOT x ON llm_called, llm_skipped)
UNION ALL SELECT 'by_source', 'rules', total FROM c""".lstrip(), MAIL_ORDERS, VERDICTS, _OPEN, HITS, SCORED).replace("\n, days AS", ",\ndays AS"),
    "slot_dedupe": with_ctes("""
SELECT message_id, strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, CASE WHEN all_day THEN 1 ELSE 0 END AS all_day,
  source, fingerprint, CASE WHEN any_review THEN 1 ELSE 0 END AS requires_review FROM winners WHERE rn = 1""", SETS),
    "conflict_marks": with_ctes("""
SELECT a.message_id, a.fingerprint, coalesce(string_agg(b.fingerprint, ',' ORDER BY b.rank, b.ord), '') AS conflicts_with,
  CASE WHEN any_value(a.any_review) OR count(b.fingerprint) > 0 THEN 1 ELSE 0 END AS requires_review
FROM (SELECT * FROM winners WHERE rn = 1) a LEFT JOIN (SELECT * FROM winners WHERE rn = 1) b
  ON a.message_id = b.message_id AND CAST(a.local_ts AS DATE) = CAST(b.local_ts AS DATE)
  AND abs(epoch(a.start_ts) - epoch(b.start_ts)) > 3600
GROUP BY a.message_id, a.fingerprint""", SETS),
    "merged_evidence": with_ctes(f"""
, noted AS (SELECT k.*, concat_ws('；', evidence, (SELECT string_agg('另有 ' || s.source || ' 给出同日全天：' || s.title, '；' ORDER BY s.rank, s.ord)
  FROM sets s WHERE NOT k.all_day AND s.all_day AND s.message_id = k.message_id AND CAST(s.local_ts AS DATE) = CAST(k.local_ts AS DATE))) AS ev FROM kept k),
folded AS (SELECT message_id, arg_min(fingerprint, (rank, ord)) AS fingerprint, bool_or(review) AS any_review,
  list_reduce(list({{'t': title, 'e': ev, 'g': generic, 's': source}} ORDER BY rank, ord), lambda a, x: {{
    't': CASE WHEN lower(x.t) <> lower(a.t) AND a.g AND NOT x.g THEN x.t ELSE a.t END,
    'e': CASE WHEN lower(x.t) <> lower(a.t) AND NOT (a.g AND NOT x.g) THEN a.e || '；另有 ' || x.s || ' 给出：' || x.t ELSE a.e END,
    'g': a.g, 's': a.s}}) AS f FROM noted GROUP BY message_id, CAST(local_ts AS DATE), slot)
SELECT message_id, fingerprint, f.t AS title, f.e AS evidence, CASE WHEN any_review THEN '{lx.GATE_LLM}' ELSE '' END AS review_reason
FROM folded""".strip(), SETS).replace(")\n, noted AS", "),\nnoted AS"),
    "outcome_summary": with_ctes("""
SELECT message_id, count(*) AS candidates, count(*) FILTER (NOT any_review) AS auto_pushable,
  count(*) FILTER (any_review) AS requires_review, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
FROM winners WHERE rn = 1 GROUP BY message_id""", SETS),
    "llm_response_normalise": """
SELECT event_id AS message_id, CASE event_id % 4 WHEN 0 THEN 't' || event_id ELSE '(无标题)' END AS title,
  strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS start_ts,
  CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts) - INTERVAL 8 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS end_ts,
  event_id % 4 AS all_day, CAST(CASE event_id % 4 WHEN 0 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE event_id % 4 WHEN 0 THEN '' ELSE 'k' || json_extract_string(props, '$.k') END AS evidence, 1 AS requires_review
FROM events WHERE event_id % 4 < 2""",
    "ics_gate": f"""
WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS s,
  CASE o_orderkey % 4 WHEN 1 THEN 'CANCEL' WHEN 2 THEN 'REPLY' WHEN 3 THEN 'REQUEST' END AS m FROM orders),
r AS (SELECT k, concat_ws('；', CASE WHEN k % 4 = 1 THEN '{lx.ICS_CANCEL}' END,
  CASE WHEN m NOT IN ('REQUEST') THEN '{lx.ICS_NOT_REQUEST[0]}' || m || '{lx.ICS_NOT_REQUEST[1]}' END,
  CASE WHEN k % 5 = 0 THEN '{lx.ICS_NO_ORGANIZER}' END, CASE WHEN s IS NULL THEN '{lx.ICS_NO_START}' END,
  CASE WHEN k % 7 = 0 THEN '{lx.ICS_NOT_CONTACT}' END, CASE WHEN s < TIMESTAMP '{NOW}' THEN '{lx.GATE_PAST}' END,
  CASE WHEN m = 'REPLY' THEN '{lx.ICS_REPLY}' WHEN s IS NULL THEN '{lx.ICS_MISSING_DTSTART}' END) AS why FROM e)
SELECT k AS message_id, CAST(CASE WHEN why = '' THEN 0.99 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE WHEN why = '' THEN 0 ELSE 1 END AS requires_review, why AS review_reason FROM r""",
    "greedy_matches": """
WITH RECURSIVE c AS (SELECT o_custkey % 40 AS name, o_custkey % 5 AS day, o_orderkey AS cand_ord, o_orderkey % 3 AS word, o_orderkey % 720 AS clock FROM orders),
t AS (SELECT user_id % 40 AS name, user_id % 5 AS day, event_id AS exp_ord, event_id % 3 AS word, event_id * 7 % 720 AS clock
  FROM events WHERE event_type = 'purchase'),
fits AS (SELECT c.name, c.day, c.cand_ord, list(t.exp_ord ORDER BY t.exp_ord) AS f, row_number() OVER (PARTITION BY c.name, c.day ORDER BY c.cand_ord) AS i
  FROM c JOIN t ON t.name = c.name AND t.day = c.day AND t.word = c.word AND abs(t.clock - c.clock) <= 45 GROUP BY c.name, c.day, c.cand_ord),
steps AS (SELECT name, day, i, cand_ord, f[1] AS exp_ord, [f[1]] AS used FROM fits WHERE i = 1
  UNION ALL SELECT n.name, n.day, n.i, n.cand_ord, list_filter(n.f, lambda x: NOT list_contains(s.used, x))[1],
    list_concat(s.used, list_filter(n.f, lambda x: NOT list_contains(s.used, x))[1:1])
  FROM steps s JOIN fits n ON n.name = s.name AND n.day = s.day AND n.i = s.i + 1)
SELECT CAST(name AS VARCHAR) AS name, cand_ord, exp_ord FROM steps WHERE exp_ord IS NOT NULL""",
    "eval_metrics": """
WITH m AS (SELECT (SELECT count(*) FROM labels WHERE quality = 1) AS expected,
  count(*) AS candidates, count(*) FILTER (quality = 1) AS matched,
  count(*) FILTER (n_chars % 2 = 1) AS auto_push,
  count(*) FILTER (n_chars % 2 = 1 AND quality = 1) AS auto_push_correct
  FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN expected > 0 THEN matched / CAST(expected AS DOUBLE) ELSE 1.0 END AS recall,
  CASE WHEN candidates > 0 THEN matched / CAST(candidates AS DOUBLE) ELSE 1.0 END AS precision,
  CASE WHEN auto_push > 0 THEN auto_push_correct / CAST(auto_push AS DOUBLE) ELSE 1.0 END AS acc FROM m)
SELECT expected, candidates, matched, auto_push, auto_push_correct, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1,
  round(acc, 6) AS auto_push_accuracy FROM r""",
}
