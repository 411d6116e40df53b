"""Text queries: masking, cleaning, html, header fields, copies, title similarity, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.functions import fingerprint as fp, headers as hd, text as tx
from mailspark.functions.common import flag, local_day, with_once
from mailspark.operators.review import probable_duplicates
from mailspark.queries.views import CAL_EVENTS, MAIL_ORDERS, cal_events, mail_orders, with_ctes
from mailspark.session import checkpointed
from mailspark.sources.tables import load, spread


def redact_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents"))
    masked = with_once(docs, masked=tx.redact(F.col("text")))
    return masked.select("doc_id", F.sha2("masked", 256).alias("masked_sha"),
                         F.length("masked").cast("long").alias("masked_chars"))


def strip_control_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    # control characters and escape sequences are woven into the given texts
    noisy = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x07\x1b[0m\r\n\x9f"))
    docs = spread(load(spark, folder, "documents")).withColumn("noisy", noisy)
    return docs.select("doc_id", F.sha2(tx.sanitize_text(F.col("noisy")), 256).alias("log_sha"),
                       tx.sanitize_error(F.col("noisy")).alias("error_text"),
                       tx.head_excerpt(F.col("text")).alias("head"))


def html_to_text_len(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(load(spark, folder, "pages"))
    read = with_once(pages, visible=tx.html_to_text(F.col("html")))
    return read.select("page_id", F.length("visible").cast("long").alias("visible_chars"),
                       F.sha2("visible", 256).alias("visible_sha"))


def clean_body_hash(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 4 == 0, F.lit("\r\n\r\n--\r\nsent by a phone")).when(
        F.col("doc_id") % 4 == 1, F.lit("\n\n> quoted line\n>> deeper   \n\n\n\nend")).when(
        F.col("doc_id") % 4 == 2, F.lit("\n\nUnsubscribe here\n\nThe team")).otherwise(F.lit("\nSent from my tablet"))
    docs = spread(load(spark, folder, "documents")).withColumn("full", F.concat("text", tail))
    done = tx.with_body(docs, F.col("full"), 4000)
    return done.select("doc_id", "body_sha256", F.sha2("body_excerpt", 256).alias("excerpt_sha"),
                       F.length("body_excerpt").cast("long").alias("excerpt_chars"), flag(F.col("truncated")).alias(
            "truncated"))


def header_fields(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    kt = k.cast("string")
    raw = load(spark, folder, "orders").select(
        k.alias("id"),
        F.concat(F.lit("  <Ab"), kt, F.lit("@EXAMPLE.Com> (note)")).alias("mid"),
        F.when(k % 3 == 0, F.concat(F.lit("<r1."), kt, F.lit("@A.b> junk <bad id> <r2@C.d>"))).otherwise(
            F.concat(F.lit("x"), kt, F.lit("@Y.z nope"))).alias("refs"),
        F.concat(F.lit("Someone <User"), kt, F.lit("@Mail.Example>, other@b.example")).alias("sender"),
        F.when(k % 4 == 0, F.concat(F.lit("<mailto:u"), kt, F.lit("@l.example?subject=x>, <https://l.example/u>"))).when(
            k % 4 == 1, F.lit("http://a.example/x, mailto:q@l.example")).otherwise(F.lit("")).alias("unsub"),
        F.create_map(F.lit("precedence"), F.when(k % 5 == 0, "Bulk").otherwise("first-class"),
                     F.lit("return-path"), F.when(k % 7 == 0, "<>").otherwise("<a@b>")).alias("headers"))
    read = with_once(raw, refs_ok=hd.parse_references(F.col("refs")), u=hd.parse_unsubscribe(F.col("unsub")))
    return read.select(
        "id", hd.normalize_message_id(F.col("mid")).alias("message_id"), F.array_join("refs_ok", " ").alias("refs"),
        hd.address_of(F.col("sender")).alias("addr"), F.array_join(hd.address_list(F.col("sender")), ",").alias("addrs"),
        flag(F.col("u.present")).alias("has_unsubscribe"), F.coalesce("u.mailto", F.lit("")).alias("mailto"),
        F.array_join("u.links", " ").alias("links"),
        F.coalesce(hd.auto_submitted(F.col("headers")), F.lit("")).alias("auto_submitted"))


def exact_copies_canonical(spark: SparkSession, folder: str) -> DataFrame:
    # the texts are read and hashed once; what follows works on ids and hashes
    docs = checkpointed(spread(load(spark, folder, "documents")).select("doc_id", F.sha2("text", 256).alias("sha")))
    # one row per content after map-side combine; the join back can be split where one content is hot
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("canonical_id"), F.count(F.lit(1)).alias("copies"))
    return docs.join(first, "sha").select(
        "doc_id", "canonical_id", flag(F.col("doc_id") == F.col("canonical_id")).alias("is_canonical"), "copies",
        F.when(F.col("doc_id") == F.col("canonical_id"), "pending").otherwise("done").alias("extract_status"))


def title_similarity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one local day with similar titles; undated ones are a block of their own."""
    day = F.coalesce(local_day(F.col("start_ts"), "Asia/Shanghai").cast("string"), F.lit("none"))
    return probable_duplicates(cal_events(spark, folder).select("id", day.alias("day"), "title"), "day", "id", "title")


def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    mail = mail_orders(spark, folder)
    start = F.col("received_at") + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))
    return mail.select(
        "id", fp.normalize_title(F.col("subject")).alias("title_norm"),
        fp.normalize_identity(F.concat(F.lit("Sender <"), F.upper("from_addr"), F.lit(">"))).alias("identity"),
        fp.normalize_ts_text(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("minute"),
        fp.event_fingerprint(F.col("subject"), start, start, F.col("from_addr"), F.concat(
            F.lit("  Room   "), (F.col("id") % 9).cast("string"))).alias("fingerprint"),
        fp.ics_fingerprint(F.concat(F.lit("u"), F.col("id").cast("string")), F.lit(None).cast("string"),
                           F.col("from_addr")).alias("ics_fingerprint"))


QUERIES = {
    "redact_pii": redact_pii, "strip_control_sanitize": strip_control_sanitize, "html_to_text_len": html_to_text_len,
    "clean_body_hash": clean_body_hash, "header_fields": header_fields,
    "exact_copies_canonical": exact_copies_canonical, "title_similarity_pairs": title_similarity_pairs,
    "fingerprint_rows": fingerprint_rows,
}

_CAP = "CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '…' ELSE {x} END"
_CTRL = r"\x1b\[[0-9;?]*[ -/]*[@-~]|[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"
_TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


_FORWARDED = (r"^[\s_\-=*]{5,}\s*$\n(?:^[ \t]*(?:" + "|".join(lx.FORWARD_LABELS) + r")[ \t]*[:：].*(?:\n|$))+")


def _html() -> str:
    text = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in ("script", "style", "noscript", "title", "head"):
        text = rf"regexp_replace({text}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '(?i)<a(?:\s[^>]*)?>\s*([^<]*?)\s*</a\s*>', '\1', 'g')"
    text = rf"regexp_replace({text}, '(?i)<br\b[^>]*>|</(?:p|div|tr|li|h[1-4]|table)\s*>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '<[/!?]?[a-zA-Z][^>]*>', '', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_FULL = """text || CASE doc_id % 4 WHEN 0 THEN chr(13)||chr(10)||chr(13)||chr(10)||'--'||chr(13)||chr(10)||'sent by a phone'
  WHEN 1 THEN chr(10)||chr(10)||'> quoted line'||chr(10)||'>> deeper   '||chr(10)||chr(10)||chr(10)||chr(10)||'end'
  WHEN 2 THEN chr(10)||chr(10)||'Unsubscribe here'||chr(10)||chr(10)||'The team'
  ELSE chr(10)||'Sent from my tablet' END"""


def _clean() -> str:
    text = r"regexp_replace(full_text, '\r\n?', chr(10), 'g')"
    text = f"regexp_replace({text}, '{_CTRL}', '', 'g')"
    text = rf"regexp_replace({text}, '(?im){_FORWARDED}', '', 'g')"
    for start in lx.TRUNCATE_FROM:
        text = rf"regexp_replace({text}, '(?im)(?:{start})[\s\S]*\z', '')"
    return rf"regexp_replace({text}, '(?m){lx.QUOTED_LINE}', '', 'g')"


def _twice(number: str, tag: str) -> str:
    """A number that touches no other digit; run twice since two neighbours share one boundary character."""
    one = rf"regexp_replace({{t}}, '(^|[^\d]){number}($|[^\d])', '\1[{tag}]\2', 'g')"
    return one.replace("{t}", one.replace("{t}", "t"))


_MARKERS = "|".join(lx.MARKETING_FOOTER_MARKERS)
_SCHEDULE = lx.SCHEDULE_SIGNAL.replace(r"(?<!\d)", "")

ORACLES = {
    "redact_pii": f"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', '[邮箱]', 'g') AS t FROM documents),
b AS (SELECT doc_id, {_twice('(?:\\+?86[- ]?)?1[3-9]\\d{9}', '手机')} AS t FROM a),
c AS (SELECT doc_id, {_twice('[1-9]\\d{5}(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dXx]', '身份证')} AS t FROM b),
d AS (SELECT doc_id, {_twice('\\d{16,19}', '卡号')} AS t FROM c)
SELECT doc_id, sha256(t) AS masked_sha, length(t) AS masked_chars FROM d""",
    "strip_control_sanitize": f"""
WITH a AS (SELECT doc_id, text, regexp_replace(chr(27)||'[31m'||text||chr(7)||chr(27)||'[0m'||chr(13)||chr(10)||chr(159), '{_CTRL}', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, t, {_TRIM.format(x="regexp_replace(replace(t, chr(10), ' '), '[ \\t]+', ' ', 'g')")} AS e,
  {_TRIM.format(x="regexp_replace(text, '\\s+', ' ', 'g')")} AS h FROM a)
SELECT doc_id, sha256({_CAP.format(x='t', n=1000)}) AS log_sha, {_CAP.format(x='e', n=500)} AS error_text,
  {_CAP.format(x='h', n=160)} AS head FROM b""",
    "html_to_text_len": f"""
WITH a AS (SELECT page_id, {_html()} AS t FROM pages)
SELECT page_id, length(t) AS visible_chars, sha256(t) AS visible_sha FROM a""",
    "clean_body_hash": f"""
WITH f AS (SELECT doc_id, {_FULL} AS full_text FROM documents),
q AS (SELECT doc_id, full_text, string_split({_clean()}, chr(10)||chr(10)) AS ps FROM f),
k AS (SELECT doc_id, full_text, ps, list_transform(ps, lambda p: CASE WHEN trim(p, ' '||chr(9)||chr(10)) = '' THEN 1
   WHEN regexp_matches(lower(p), '{_MARKERS}') THEN 2 WHEN regexp_matches(p, '{_SCHEDULE}') THEN 0
   WHEN length(trim(p, ' '||chr(9)||chr(10))) <= 40 AND NOT regexp_matches(p, '[。！？.!?]') THEN 1 ELSE 0 END) AS ks FROM q),
l AS (SELECT *, list_max(list_transform(ks, lambda x, i: CASE WHEN x = 0 OR i = 1 THEN i ELSE 0 END)) AS last FROM k),
c AS (SELECT doc_id, full_text, array_to_string(CASE WHEN list_contains(ks[last+1:], 2) THEN ps[:last] ELSE ps END, chr(10)||chr(10)) AS t FROM l),
d AS (SELECT doc_id, full_text, {_TRIM.format(x="regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g')")} AS t FROM c)
SELECT doc_id, sha256(full_text) AS body_sha256, sha256(substr(t, 1, 4000)) AS excerpt_sha,
  length(substr(t, 1, 4000)) AS excerpt_chars, CASE WHEN length(t) > 4000 THEN 1 ELSE 0 END AS truncated FROM d""",
    "header_fields": r"""
SELECT o_orderkey AS id, 'Ab' || o_orderkey || '@example.com' AS message_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'r1.' || o_orderkey || '@a.b r2@c.d' ELSE 'x' || o_orderkey || '@y.z' END AS refs,
  'user' || o_orderkey || '@mail.example' AS addr, 'user' || o_orderkey || '@mail.example,other@b.example' AS addrs,
  CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END AS has_unsubscribe,
  CASE o_orderkey % 4 WHEN 0 THEN 'u' || o_orderkey || '@l.example' WHEN 1 THEN 'q@l.example' ELSE '' END AS mailto,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://l.example/u' WHEN 1 THEN 'http://a.example/x' ELSE '' END AS links,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Precedence: Bulk' WHEN o_orderkey % 7 = 0 THEN 'Return-Path 为空（退信特征）' ELSE '' END AS auto_submitted
FROM orders""",
    "exact_copies_canonical": """
WITH c AS (SELECT text, min(doc_id) AS canonical_id, count(*) AS copies FROM documents GROUP BY text)
SELECT doc_id, canonical_id, CASE WHEN doc_id = canonical_id THEN 1 ELSE 0 END AS is_canonical, copies,
  CASE WHEN doc_id = canonical_id THEN 'pending' ELSE 'done' END AS extract_status
FROM documents JOIN c USING (text)""",
    "title_similarity_pairs": "WITH " + CAL_EVENTS + r""", t AS (SELECT id, coalesce(strftime(start_ts + INTERVAL 8 HOUR, '%Y-%m-%d'), 'none') AS day, list_sort(list_distinct(list_filter(string_split(
    regexp_replace(lower(title), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 3))) AS toks
  FROM cal_events),
p AS (SELECT a.day, a.id, b.id AS other,
    len(list_intersect(a.toks, b.toks)) / CAST(least(len(a.toks), len(b.toks)) AS DOUBLE) AS sim
  FROM t a JOIN t b ON a.day = b.day AND b.id < a.id WHERE len(a.toks) > 0 AND len(b.toks) > 0)
SELECT day, id, min(other) AS duplicate_of, round(arg_min(sim, other), 2) AS similarity
FROM p WHERE sim >= 0.8 GROUP BY day, id""",
    "fingerprint_rows": with_ctes(r"""
SELECT id, title_norm, lower(from_addr) AS identity, strftime(s, '%Y-%m-%d %H:%M') AS minute,
  substr(sha256(title_norm || chr(31) || strftime(s, '%Y-%m-%d %H:%M') || chr(31) || strftime(s, '%Y-%m-%d %H:%M')
    || chr(31) || from_addr || chr(31) || 'room ' || (id % 9)), 1, 32) AS fingerprint,
  substr(sha256('u' || id || chr(31) || chr(31) || from_addr), 1, 32) AS ics_fingerprint
FROM (SELECT *, received_at + to_hours(id % 24) AS s,
  lower(regexp_replace(subject, '^(Invitation: |Re: )', '')) AS title_norm FROM mail_orders)""", MAIL_ORDERS),
}
