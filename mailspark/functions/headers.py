"""Header fields as columns: message ids, references, addresses, unsubscribe targets, bulk marks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailspark.functions.common import nonempty, strip


def normalize_message_id(raw: Column) -> Column:
    """Bare id with a lower-case domain, or null when it is no usable id."""
    first = F.get(F.split(strip(raw), r"(?U)\s+"), F.lit(0))
    bare = F.regexp_replace(first, r"^[<>]+|[<>]+$", "")
    local = F.regexp_extract(bare, r"^([^@]*)@", 1)
    domain = F.regexp_extract(bare, r"^[^@]*@(.*)$", 1)
    whole = F.concat(local, F.lit("@"), F.lower(domain))
    return F.when((F.length(local) > 0) & (F.length(domain) > 0) & whole.rlike(r"^[!-~]+@[!-~]+$"), whole)


def parse_references(raw: Column) -> Column:
    """All usable ids of a References or In-Reply-To header, in order."""
    raw = F.coalesce(raw, F.lit(""))
    bracketed = F.regexp_extract_all(raw, F.lit(r"<[^<>]+>"), F.lit(0))
    loose = F.filter(F.split(strip(raw), r"(?U)\s+"), lambda t: F.contains(t, F.lit("@")))
    tokens = F.when(F.size(bracketed) > 0, bracketed).otherwise(loose)
    return F.filter(F.transform(tokens, normalize_message_id), lambda t: t.isNotNull())


def address_of(raw: Column) -> Column:
    """The first address of a plain address header, lower case; '' when there is none.

    Full RFC 2822 groups and encoded names are handled where raw messages are parsed.
    """
    return F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), r"([^\s<>,;\"]+@[^\s<>,;\"]+)", 1))


def address_list(raw: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"([^\s<>,;\"]+@[^\s<>,;\"]+)"), F.lit(1))
    return F.transform(found, F.lower)


def parse_unsubscribe(raw: Column) -> Column:
    """struct(present, mailto, links) of a List-Unsubscribe header. Targets are listed, never opened."""
    text = strip(F.coalesce(raw, F.lit("")))
    bracketed = F.regexp_extract_all(text, F.lit(r"<([^>]+)>"), F.lit(1))
    loose = F.filter(F.transform(F.split(text, ","), strip), lambda t: F.length(t) > 0)
    targets = F.when(F.size(bracketed) > 0, bracketed).otherwise(loose)
    mail = F.get(F.filter(targets, lambda t: F.startswith(F.lower(t), F.lit("mailto:"))), F.lit(0))
    return F.struct(
        (F.length(text) > 0).alias("present"),
        strip(F.regexp_replace(F.substr(mail, F.lit(8)), r"(?s)\?.*$", "")).alias("mailto"),
        F.filter(targets, lambda t: t.rlike(r"(?i)^https?://")).alias("links"),
    )


def header(headers: Column, name: str) -> Column:
    """A header of a lower-keyed map; empty text counts as absent."""
    return nonempty(strip(F.try_element_at(headers, F.lit(name))))


def auto_submitted(headers: Column) -> Column:
    """Evidence that a message was sent by a machine, else null."""
    auto = header(headers, "auto-submitted")
    precedence = header(headers, "precedence")
    marks = [
        F.when(F.lower(auto) != "no", F.concat(F.lit("Auto-Submitted: "), auto)),
        F.when(F.lower(precedence).isin("bulk", "junk", "list"), F.concat(F.lit("Precedence: "), precedence)),
    ]
    for name in ("x-autoreply", "x-autorespond", "x-auto-response-suppress"):
        marks.append(F.when(header(headers, name).isNotNull(), F.lit(f"{name} 存在")))
    marks.append(F.when(header(headers, "return-path") == "<>", F.lit("Return-Path 为空（退信特征）")))
    return F.coalesce(*marks)


def is_list_mail(headers: Column) -> Column:
    names = ("list-id", "list-post", "list-unsubscribe", "x-mailing-list")
    return F.coalesce(*[header(headers, n) for n in names]).isNotNull()


def is_seen(flags: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(flags, F.lower), "\\seen"), F.lit(False))
