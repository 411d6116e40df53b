"""Raw messages: scan, and parsing with the standard library's mail parser inside Arrow batches.

Python only takes a message apart (headers decoded, longest body parts picked, calendar parts found). Everything
that can be said as a column - html to text, cleaning, ids, references, bulk marks - runs in the JVM afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import timezone
from email import message_from_bytes
from email.message import Message
from email.utils import parsedate_to_datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import lexicon as lx
from mailspark.functions import headers as hd
from mailspark.functions.common import with_once
from mailspark.functions.text import html_to_text, with_body
from mailspark.sources.decoding import Bigrams, Mailbox, header_bytes, header_text, mailboxes, to_text

PARSED = (
    "subject string, from_addr string, from_name string, to_addrs array<string>, sent_at string, "
    "headers map<string,string>, plain string, html string, defects array<string>, "
    "ics_parts array<struct<raw:binary,filename:string,content_type:string,inline:boolean>>")

_ARROW = pa.schema([
    ("subject", pa.string()), ("from_addr", pa.string()), ("from_name", pa.string()),
    ("to_addrs", pa.list_(pa.string())), ("sent_at", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("plain", pa.string()), ("html", pa.string()), ("defects", pa.list_(pa.string())),
    ("ics_parts", pa.list_(pa.struct([("raw", pa.binary()), ("filename", pa.string()),
                                      ("content_type", pa.string()), ("inline", pa.bool_())]))),
])


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """A folder tree of .eml files as raw messages: the parent folder names the mailbox folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
    return files.load(path).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([0-9]+)\.eml$", 1).try_cast("long").alias("uid"),
        F.col("content").alias("raw"), F.expr("cast(array() as array<string>)").alias("flags"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("internal_date"),
        F.col("length").alias("size"))


def parse_messages(raw: DataFrame, max_chars: int | None = None, column: str = "raw", model: Bigrams | None = None) -> DataFrame:
    """Raw bytes to the parsed record, one row per message; a broken field is null or empty, never an error.

    ``model`` (decoding.learn_charsets) tells charsets apart that a message does not name, or names wrongly.
    """
    shared = raw.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in raw.schema.fields if f.name != column]
    position = raw.columns.index(column)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, position)):
            parsed = [take_apart(v.as_py() or b"", shared.value) for v in batch.column(position)]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != position]
            names = [n for i, n in enumerate(batch.schema.names) if i != position]
            arrays += [pa.array([p[f.name] for p in parsed], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays(arrays, names=names + _ARROW.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    opened = raw.mapInArrow(parse, f"{schema}, {PARSED}" if schema else PARSED)
    head = F.col("headers")
    full = F.when(F.length("plain") > 0, F.col("plain")).otherwise(html_to_text(F.col("html")))
    read = with_body(opened, full, max_chars)
    read = with_once(
        read, unsubscribe=hd.parse_unsubscribe(hd.header(head, "list-unsubscribe")),
        normalized_message_id=hd.normalize_message_id(hd.header(head, "message-id")),
        in_reply_to=F.get(hd.parse_references(hd.header(head, "in-reply-to")), F.lit(0)),
        references_ids=hd.parse_references(hd.header(head, "references")),
        list_id=hd.header(head, "list-id"), auto_submitted=hd.auto_submitted(head), is_list=hd.is_list_mail(head))
    return read.select(
        *[F.col(f.name) for f in kept], "subject", "from_addr", "from_name", "to_addrs", "normalized_message_id",
        "in_reply_to", "references_ids", F.try_to_timestamp("sent_at").alias("sent_at"),
        (F.size("ics_parts") > 0).alias("has_ics"), F.col("unsubscribe.present").alias("has_unsubscribe"),
        F.col("unsubscribe.mailto").alias("unsubscribe_mailto"), F.col("unsubscribe.links").alias("unsubscribe_links"),
        "list_id", "auto_submitted", "is_list", "body_excerpt", "body_sha256", "truncated",
        (F.length("plain") == 0).alias("had_html"), "defects", "ics_parts")


def portions(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of some ``limit`` bytes of a binary column, a row at least: what Python holds of a
    message is a multiple of its bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


# --- one message ----------------------------------------------------------------------------------------------


def take_apart(raw: bytes, model: Bigrams | None = None) -> dict:
    message = message_from_bytes(raw)
    headers: dict[str, str] = {}
    for key, value in message.raw_items():
        name = key.lower()
        headers[name] = f"{headers[name]}, {value}" if name in headers else str(value)
    senders = _safe(lambda: mailboxes(headers.get("from"), model), [])
    sender = senders[0] if senders else Mailbox("", _safe(lambda: header_text(headers.get("from"), model), ""))
    bodies: dict[str, str] = {"text/plain": "", "text/html": ""}
    ics = []
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = (part.get_content_type() or "").lower()
        filename = _safe(part.get_filename, None)
        filename = header_text(filename, model) if filename else None
        attached = (_safe(part.get_content_disposition, "") or "").lower() == "attachment"
        payload = _payload(part)
        if kind in lx.ICS_MIME_TYPES or (filename and filename.lower().endswith(lx.ICS_EXTENSIONS)):
            ics.append({"raw": payload, "filename": filename, "content_type": kind, "inline": not attached})
        if kind in bodies and not attached and payload:
            text = to_text(payload, _safe(part.get_content_charset, None), model)
            if len(text) > len(bodies[kind]):
                bodies[kind] = text
    return {
        "subject": _safe(lambda: header_text(_unfolded(headers.get("subject")), model), ""),
        "from_addr": sender.address, "from_name": sender.name,
        "to_addrs": [m.address for m in _safe(lambda: mailboxes(headers.get("to"), model), [])],
        "sent_at": _safe(lambda: _utc(headers.get("date")), None),
        "headers": [(k, _clean(to_text(header_bytes(v), None, model))) for k, v in headers.items()],
        "plain": _clean(bodies["text/plain"]), "html": _clean(bodies["text/html"]),
        "defects": [type(d).__name__ for d in message.defects], "ics_parts": ics,
    }


def _safe(call, default):
    try:
        return call()
    except Exception:  # noqa: BLE001 - a malformed field must not cost the message
        return default


def _unfolded(value: str | None) -> str | None:
    return re.sub(r"\r?\n(?=[ \t])", "", value) if value else value


def _clean(text: str) -> str:
    """Lone surrogates cannot cross into UTF-8 columns."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _payload(part: Message) -> bytes:
    payload = _safe(lambda: part.get_payload(decode=True), None)
    if payload is None:
        text = _safe(part.get_payload, "")
        payload = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    return payload


def _utc(raw: str | None) -> str | None:
    if not raw:
        return None
    stamp = parsedate_to_datetime(str(raw))
    stamp = stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)
    return stamp.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
