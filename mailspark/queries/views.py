"""Mail-shaped views of the given tables: once as DataFrames, once as SQL common table expressions.

The given tables hold no mail, so orders, conversations and events are read as messages and calendar entries by
fixed rules. Every row of the base table becomes a row of its view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.sources.tables import load, spread

NOW = "1998-01-01 00:00:00"
STATUSES = lx.EVENT_STATUSES


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(text: str, words) -> str:
    return f"(len(list_filter({sql_list(dict.fromkeys(words))}, lambda w: contains({text}, w))) > 0)"


def with_ctes(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + sql


# --- orders as messages ---------------------------------------------------------------------------------------


def mail_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = spread(load(spark, folder, "orders")), load(spark, folder, "customer")
    joined = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    k = F.col("o_orderkey")
    kt = k.cast("string")

    def day(extra: int) -> Column:
        return F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 20 + extra).cast("int")), "yyyy-MM-dd")

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    d1, d2 = day(0), day(3)
    c1 = F.concat(two(k % 11 + 8), F.lit(":"), two(k % 4 * 15))
    c2 = F.concat(two(k % 9 + 10), F.lit(":"), two(k % 3 * 20))
    body = (
        F.when(k % 8 == 0, F.format_string("The review meeting is on %s at %s in room %s.\n\nRegards", d1, c1, kt))
        .when(k % 8 == 1, F.format_string("Payment deadline %s. Please settle your balance.", d1))
        .when(k % 8 == 2, F.format_string("Great discount, click to unsubscribe. Offer valid %s.", d1))
        .when(k % 8 == 3, F.format_string(
            "Delivery window %s %s.\n\nSource: carrier feed, terms apply from %s.", d1, c1, d2))
        .when(k % 8 == 4, F.format_string("Your verification code is %s.", kt))
        .when(k % 8 == 5, F.format_string("Nothing to report for order %s.", kt))
        .when(k % 8 == 6, F.format_string("Seminar on %s at %s, or around %s at %s.", d1, c1, d2, c2))
        .otherwise(F.format_string("Flight details follow.\n\nDate %s\n\nTime %s", d1, c1)))
    subject = (F.when(k % 10 == 0, F.concat(F.lit("Invitation: order "), kt))
               .when(k % 10 == 1, F.concat(F.lit("Re: order "), kt, F.lit(" status")))
               .when(k % 10 == 2, F.concat(F.lit("Reminder order "), kt))
               .otherwise(F.concat(F.lit("Order "), kt, F.lit(" update"))))
    none = F.lit(None).cast("string")
    return joined.select(
        k.alias("id"), F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("account"),
        F.col("o_orderpriority").alias("folder"), F.lit(1).cast("long").alias("uid_validity"), k.alias("uid"),
        F.concat(F.lit("m"), kt, F.lit("@x")).alias("normalized_message_id"), subject.alias("subject"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("from_addr"), body.alias("body_excerpt"),
        F.col("o_orderdate").alias("received_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 100).cast("int"))).alias("fetched_at"),
        F.when(k % 13 == 0, F.lit("auto-replied")).otherwise(none).alias("auto_submitted"),
        (k % 7 == 3).alias("is_list"), (k % 97 == 0).alias("has_ics"), (k % 7 == 3).alias("has_unsubscribe"),
        F.when(k % 21 == 3, F.concat(F.lit("list"), (k % 5).cast("string"))).otherwise(none).alias("list_id"),
        (k % 17 != 0).alias("is_canonical"), (k % 19 == 0).alias("stale"), (k % 23 == 0).alias("folder_moved"),
        F.when(k % 7 == 0, "pending").when(k % 7 == 1, "running").when(k % 7 == 2, "failed").otherwise("done").alias(
            "extract_status"),
        (k % 5).cast("int").alias("extract_attempts"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("\\Seen")))
        .when(F.col("o_orderstatus") == "P", F.array(F.lit("\\SEEN"), F.lit("\\Flagged")))
        .otherwise(F.expr("cast(array() as array<string>)")).alias("flags"),
        F.when(k % 29 == 0, F.col("o_orderdate")).alias("marked_read_at"))


_DAY = "strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 + {n} AS INTEGER), '%Y-%m-%d')"
_D1, _D2 = _DAY.format(n=0), _DAY.format(n=3)
_C1 = "lpad(CAST(o_orderkey % 11 + 8 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 4 * 15 AS VARCHAR), 2, '0')"
_C2 = "lpad(CAST(o_orderkey % 9 + 10 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 3 * 20 AS VARCHAR), 2, '0')"

MAIL_ORDERS = f"""mail_orders AS (
SELECT o_orderkey AS id, 'a' || CAST(o_custkey % 3 AS VARCHAR) AS account, o_orderpriority AS folder,
  1 AS uid_validity, o_orderkey AS uid, 'm' || o_orderkey || '@x' AS normalized_message_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Invitation: order ' || o_orderkey
       WHEN o_orderkey % 10 = 1 THEN 'Re: order ' || o_orderkey || ' status'
       WHEN o_orderkey % 10 = 2 THEN 'Reminder order ' || o_orderkey
       ELSE 'Order ' || o_orderkey || ' update' END AS subject,
  lower(c_name) || '@example.com' AS from_addr,
  CASE o_orderkey % 8
   WHEN 0 THEN 'The review meeting is on ' || {_D1} || ' at ' || {_C1} || ' in room ' || o_orderkey || '.' || chr(10) || chr(10) || 'Regards'
   WHEN 1 THEN 'Payment deadline ' || {_D1} || '. Please settle your balance.'
   WHEN 2 THEN 'Great discount, click to unsubscribe. Offer valid ' || {_D1} || '.'
   WHEN 3 THEN 'Delivery window ' || {_D1} || ' ' || {_C1} || '.' || chr(10) || chr(10) || 'Source: carrier feed, terms apply from ' || {_D2} || '.'
   WHEN 4 THEN 'Your verification code is ' || o_orderkey || '.'
   WHEN 5 THEN 'Nothing to report for order ' || o_orderkey || '.'
   WHEN 6 THEN 'Seminar on ' || {_D1} || ' at ' || {_C1} || ', or around ' || {_D2} || ' at ' || {_C2} || '.'
   ELSE 'Flight details follow.' || chr(10) || chr(10) || 'Date ' || {_D1} || chr(10) || chr(10) || 'Time ' || {_C1} END AS body_excerpt,
  o_orderdate AS received_at, o_orderdate + to_hours(o_orderkey % 100) AS fetched_at,
  CASE WHEN o_orderkey % 13 = 0 THEN 'auto-replied' END AS auto_submitted,
  o_orderkey % 7 = 3 AS is_list, o_orderkey % 97 = 0 AS has_ics, o_orderkey % 7 = 3 AS has_unsubscribe,
  CASE WHEN o_orderkey % 21 = 3 THEN 'list' || (o_orderkey % 5) END AS list_id,
  o_orderkey % 17 <> 0 AS is_canonical, o_orderkey % 19 = 0 AS stale, o_orderkey % 23 = 0 AS folder_moved,
  CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS extract_status,
  CAST(o_orderkey % 5 AS INTEGER) AS extract_attempts,
  o_orderstatus IN ('F', 'P') AS seen,
  CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate END AS marked_read_at
FROM orders JOIN customer ON c_custkey = o_custkey)"""

# --- orders as calendar entries -------------------------------------------------------------------------------


def cal_events(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    k = F.col("o_orderkey")
    kt = k.cast("string")
    none = F.lit(None).cast("string")
    source = F.when(k % 3 == 0, "ics").when(k % 3 == 1, "rules").otherwise("llm")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "approved").otherwise(
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 12 + 1).cast("int")))
    # the entries of one message share a day, give or take the clock
    start = F.when(k % 41 != 0, F.lit("1995-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
        days=((k - k % 3) % 2400).cast("int"), hours=(k % 11).cast("int"), mins=(k % 72 * 20).cast("int")))
    return (load(spark, folder, "orders") if orders is None else orders).select(
        k.alias("id"), (k - k % 3).alias("message_id"), F.lit(None).cast("long").alias("thread_id"),
        F.concat(F.lit("order "), F.lower("o_orderpriority"), F.lit(" no "), (k % 50).cast("string")).alias("title"),
        start.alias("start_ts"), (start + F.make_dt_interval(mins=F.lit(30))).alias("end_ts"),
        (k % 9 == 0).alias("all_day"), F.lit("Asia/Shanghai").alias("tz"), none.alias("location"),
        F.concat(F.lit("Org"), (k % 7).cast("string"), F.lit("@Example.com")).alias("organizer"),
        source.alias("source"), ((k % 50 + 50) / 100.0).cast("double").alias("confidence"),
        F.concat(F.lit("fp"), kt).alias("fingerprint"),
        F.when(k % 5 == 0, F.concat(F.lit("[待审：无年份日期] seen in order "), kt)).otherwise(
            F.concat(F.lit("seen in order "), kt)).alias("evidence"),
        status.alias("status"), F.lit(None).cast("map<string,string>").alias("field_provenance"),
        (k % 6 == 0).alias("needs_attention"),
        F.when(k % 8 == 5, F.concat(F.lit("g"), kt)).otherwise(none).alias("gcal_event_id"),
        F.when(k % 8 == 5, F.concat(F.lit("e"), (k % 3).cast("string"))).otherwise(none).alias("gcal_etag"),
        none.alias("remote_norm_hash"), none.alias("local_norm_hash"), none.alias("snapshot_hash"),
        none.alias("snapshot_payload"), none.alias("managed_state"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
        F.when(k % 3 == 0, F.concat(F.lit("uid"), F.floor(k / 30).cast("string"))).otherwise(none).alias("ics_uid"),
        F.when(k % 3 == 0, (k % 5).cast("int")).alias("ics_sequence"), none.alias("ics_recurrence_id"),
        none.alias("ics_rrule"), (k % 4).cast("int").alias("push_attempts"), (k % 10 == 7).alias("manual_edited"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


CAL_EVENTS = f"""cal_events AS (
SELECT *, start_ts + INTERVAL 30 MINUTE AS end_ts FROM (
SELECT o_orderkey AS id, o_orderkey - o_orderkey % 3 AS message_id,
  'order ' || lower(o_orderpriority) || ' no ' || (o_orderkey % 50) AS title,
  CASE WHEN o_orderkey % 41 <> 0 THEN TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((o_orderkey - o_orderkey % 3) % 2400 AS INTEGER))
    + to_hours(o_orderkey % 11) + to_minutes(o_orderkey % 72 * 20) END AS start_ts,
  o_orderkey % 9 = 0 AS all_day, 'Org' || (o_orderkey % 7) || '@Example.com' AS organizer,
  CASE o_orderkey % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'rules' ELSE 'llm' END AS source,
  CAST((o_orderkey % 50 + 50) / 100.0 AS DOUBLE) AS confidence, 'fp' || o_orderkey AS fingerprint,
  CASE WHEN o_orderkey % 5 = 0 THEN '[待审：无年份日期] seen in order ' || o_orderkey ELSE 'seen in order ' || o_orderkey END AS evidence,
  CASE WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 4 = 1 THEN 'approved'
       ELSE {sql_list(STATUSES)}[CAST(o_orderkey % 12 + 1 AS INTEGER)] END AS status,
  o_orderkey % 6 = 0 AS needs_attention,
  CASE WHEN o_orderkey % 8 = 5 THEN 'g' || o_orderkey END AS gcal_event_id,
  CASE WHEN o_orderkey % 8 = 5 THEN 'e' || (o_orderkey % 3) END AS gcal_etag,
  CASE WHEN o_orderkey % 3 = 0 THEN 'uid' || (o_orderkey // 30) END AS ics_uid,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS ics_sequence,
  o_orderkey % 4 AS push_attempts, o_orderkey % 10 = 7 AS manual_edited, o_orderdate AS created_at
FROM orders))"""


def cal_pushes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, folder, "orders").select(
        (k * 10 + 1).alias("id"), k.alias("event_id"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=(k % 3000).cast("int"))).alias("scheduled_for"),
        F.when(k % 5 == 3, "dispatched").when(k % 5 == 4, "cancelled").otherwise("queued").alias("state"),
        F.lit(None).cast("string").alias("run_id"), F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp").alias("dispatched_at"), F.lit(None).cast("string").alias("error"))


CAL_PUSHES = """cal_pushes AS (
SELECT o_orderkey * 10 + 1 AS id, o_orderkey AS event_id, o_orderdate + to_minutes(o_orderkey % 3000) AS scheduled_for,
  CASE o_orderkey % 5 WHEN 3 THEN 'dispatched' WHEN 4 THEN 'cancelled' ELSE 'queued' END AS state
FROM orders)"""

# --- conversations as threads ---------------------------------------------------------------------------------


def mail_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as messages: most answer the turn before; every fifth answers a message that is not there; every
    seventh only has References."""
    base = load(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    ident = conv * 1000 + turn

    def mid(n: Column) -> Column:
        return F.concat(F.lit("c"), conv.cast("string"), F.lit("."), n.cast("string"), F.lit("@x"))

    irt = (F.when((turn == 0) | (ident % 7 == 0), F.lit(None))
           .when(ident % 5 == 0, F.concat(F.lit("gone"), conv.cast("string"), F.lit("@y"))).otherwise(mid(turn - 1)))
    refs = F.when(turn > 0, F.transform(F.sequence(F.lit(0).cast("long"), turn - 1), mid)).otherwise(
        F.expr("cast(array() as array<string>)"))
    return base.select(
        ident.alias("id"), F.lit("a").alias("account"), mid(turn).alias("normalized_message_id"),
        irt.alias("in_reply_to"), refs.alias("references_ids"),
        F.concat(F.lit("Re: topic "), (conv % 7).cast("string")).alias("subject"),
        (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
            days=(conv % 300).cast("int"), mins=turn.cast("int"))).alias("received_at"),
        F.col("role").alias("from_addr"), F.sha2("text", 256).alias("body_sha256"),
        F.lit(None).cast("string").alias("auto_submitted"), F.lit(True).alias("is_canonical"),
        F.lit(False).alias("stale"))


MAIL_TURNS = """mail_turns AS (
SELECT conv_id * 1000 + turn AS id, conv_id, turn, 'c' || conv_id || '.' || turn || '@x' AS mid,
  CASE WHEN turn = 0 OR (conv_id * 1000 + turn) % 7 = 0 THEN NULL
       WHEN (conv_id * 1000 + turn) % 5 = 0 THEN 'gone' || conv_id || '@y'
       ELSE 'c' || conv_id || '.' || (turn - 1) || '@x' END AS irt,
  'topic ' || (conv_id % 7) AS subject_norm,
  TIMESTAMP '2026-01-01 00:00:00' + to_days(CAST(conv_id % 300 AS INTEGER)) + to_minutes(turn) AS received_at,
  role AS from_addr
FROM conversations)"""

# --- events as messages of folders ----------------------------------------------------------------------------


def mail_events(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return load(spark, folder, "events").select(
        e.alias("id"), F.lit("a").alias("account"), F.col("event_type").alias("folder"),
        F.lit(1).cast("long").alias("uid_validity"), e.alias("uid"), F.col("ts").alias("received_at"),
        F.col("ts").alias("fetched_at"), F.col("ts").alias("sent_at"),
        F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@D"), (F.col("user_id") % 9).cast("string"),
                 F.lit(".example")).alias("from_addr"),
        F.concat(F.lit("Name "), (e % 4).cast("string")).alias("from_name"),
        F.when(F.col("value") > 10, F.array(F.lit("\\Seen"))).otherwise(
            F.expr("cast(array() as array<string>)")).alias("flags"),
        (e % 11 == 0).alias("has_unsubscribe"),
        F.when(F.col("event_type") == "error", F.lit("errors.list")).alias("list_id"),
        F.when(e % 6 == 0, "pending").when(e % 6 == 1, "running").when(e % 6 == 2, "failed").otherwise("done").alias(
            "extract_status"),
        (e % 5).cast("int").alias("extract_attempts"), (e % 17 != 0).alias("is_canonical"),
        F.sha2(F.concat(F.lit("b"), ((e - e % 2) % 9000).cast("string")), 256).alias("body_sha256"),
        F.concat(F.lit("e"), (e % 7000).cast("string"), F.lit("@x")).alias("normalized_message_id"), "value", "props")


MAIL_EVENTS = """mail_events AS (
SELECT event_id AS id, 'a' AS account, event_type AS folder, 1 AS uid_validity, event_id AS uid, ts AS received_at,
  ts AS fetched_at, ts AS sent_at, 'User' || user_id || '@D' || (user_id % 9) || '.example' AS from_addr,
  'Name ' || (event_id % 4) AS from_name, value > 10 AS seen, event_id % 11 = 0 AS has_unsubscribe,
  CASE WHEN event_type = 'error' THEN 'errors.list' END AS list_id,
  CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS extract_status,
  event_id % 5 AS extract_attempts, event_id % 17 <> 0 AS is_canonical,
  'b' || ((event_id - event_id % 2) % 9000) AS body, 'e' || (event_id % 7000) || '@x' AS mid, value, props
FROM events)"""
