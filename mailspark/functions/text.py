"""Cleaning and masking of message text (html, quotes, footers, control characters, personal data)."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import by_script, contains_any, fold_spaces, let, matches, nonempty, rx, strip, sub, with_once

LOG_MAX_CHARS = 1000
ERROR_MAX_CHARS = 500
HEAD_MAX_CHARS = 160


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, lx.CONTROL, "")


def capped(text: Column, limit: int) -> Column:
    return let(text, lambda t: F.when(
        F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t))


def sanitize_text(text: Column, limit: int = LOG_MAX_CHARS) -> Column:
    return capped(strip_control(text), limit)


def sanitize_error(text: Column, limit: int | None = ERROR_MAX_CHARS) -> Column:
    """One clean line; ``limit`` None keeps all of it."""
    one_line = F.regexp_replace(strip_control(text), r"[\r\n]", " ")
    line = strip(F.regexp_replace(one_line, r"[ \t]+", " "))
    return line if limit is None else capped(line, limit)


def head_excerpt(text: Column, limit: int = HEAD_MAX_CHARS) -> Column:
    return capped(fold_spaces(F.coalesce(text, F.lit(""))), limit)


def redact(text: Column) -> Column:
    """Mask addresses, mobile numbers, identity numbers and card numbers, in that order."""
    for pattern, tag in lx.REDACTIONS:
        text = sub(text, pattern, tag)
    return text


# --- html -----------------------------------------------------------------------------------------------------

_DROPPED_ELEMENTS = ("script", "style", "noscript", "title", "head")


def html_to_text(source: Column) -> Column:
    """Visible text of a page: scripts and heads dropped, anchors flattened, block ends and breaks as newlines."""
    text = F.regexp_replace(source, r"(?s)<!--.*?-->", "")
    for name in _DROPPED_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    text = _flatten_anchors(text)
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>|</(?:p|div|tr|li|h[1-4]|table)\s*>", "\n")
    text = F.regexp_replace(text, r"<[/!?]?[a-zA-Z][^>]*>|<!\[[^>]*>", "")
    return unescape_entities(text)


def _flatten_anchors(text: Column) -> Column:
    """Each anchor becomes its own text pieces, trimmed and joined by one blank."""
    def anchor(piece: Column) -> Column:
        body = F.regexp_replace(piece, r"^[^>]*>", "")
        inner = F.regexp_extract(body, r"(?is)^(.*?)</a\s*>", 1)
        pieces = F.filter(F.transform(F.split(inner, r"<[^>]*>"), strip), lambda s: F.length(s) > 0)
        closed = F.concat(F.array_join(pieces, " "), F.regexp_replace(body, r"(?is)^.*?</a\s*>", ""))
        return F.when(piece.rlike(r"(?i)</a\s*>"), closed).otherwise(body)

    pieces = F.split(text, r"(?i)<a(?=[\s>])", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(anchor(p))), "")


def unescape_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once. The name table is the HTML 5 standard's."""
    named = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    table = F.from_json(F.lit(json.dumps(named)), "map<string,string>")

    def reference(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        decimal = F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = F.coalesce(nonempty(decimal).cast("int"), F.conv(nonempty(hexa), 16, 10).cast("int"))
        char = F.coalesce(F.try_element_at(table, nonempty(name)), let(code, lambda c: F.when(
            (c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF),
            F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))))
        rest = F.regexp_replace(piece, r"^[^;]*;", "")
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(reference(p))), "")


# --- body cleaning --------------------------------------------------------------------------------------------


# A ruled line and the labelled lines below it. The lines are taken one by one and never given back, so their number
# does not matter to the matcher.
_LABELLED_LINE = rf"[ \t]*+(?:{'|'.join(lx.FORWARD_LABELS)})[ \t]*+[:：][^\n]*+(?:\n|\z)"
_FORWARD_HEADER = rf"^[\s_\-=*]{{5,}}\s*$\n(?:{_LABELLED_LINE})++"


def clean_body(text: Column) -> Column:
    """The stored excerpt source: newlines unified first, then each cleaning step in its fixed order."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    text = strip_control(text)
    text = sub(text, _FORWARD_HEADER, "", "idm")
    for start in lx.TRUNCATE_FROM:
        text = sub(text, rf"(?:{start})[\s\S]*\z", "", "idm")
    text = sub(text, lx.QUOTED_LINE, "", "dm")
    text = strip_footer(text)
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def strip_footer(text: Column) -> Column:
    """Cut the trailing run of footer-like paragraphs, but only when one of them carries a marker word."""
    def cut(t: Column) -> Column:
        return let(F.split(t, "\n\n", -1), lambda paragraphs: let(
            F.transform(paragraphs, _footer_kind), lambda kinds: let(
                F.array_max(F.transform(kinds, lambda k, i: F.when((k == 0) | (i == 0), i).otherwise(F.lit(0)))),
                lambda last: F.when(F.exists(F.slice(kinds, last + 2, F.size(kinds)), lambda k: k == 2),
                                    F.array_join(F.slice(paragraphs, F.lit(1), last + 1), "\n\n")).otherwise(t))))

    return let(text, lambda t: F.when(
        contains_any(F.lower(t), lx.MARKETING_FOOTER_MARKERS) & F.contains(t, F.lit("\n\n")), cut(t)).otherwise(t))


def _footer_kind(paragraph: Column) -> Column:
    """2 = carries a marker, 1 = short and unpunctuated, 0 = body."""
    trimmed = strip(paragraph)
    return (F.when(F.length(trimmed) == 0, 1)
            .when(contains_any(F.lower(paragraph), lx.MARKETING_FOOTER_MARKERS), 2)
            .when(matches(paragraph, lx.SCHEDULE_SIGNAL), 0)
            .when((F.length(trimmed) <= 40) & ~trimmed.rlike("[。！？.!?]"), 1)
            .otherwise(0))


def with_body(df: DataFrame, full_text: Column, max_chars: int | None = None) -> DataFrame:
    """Add body_excerpt, body_sha256 (over the uncleaned text) and truncated. Without a limit the excerpt is all of
    the cleaned text, which is what extraction has to read."""
    excerpt, cut = (F.col("_clean"), F.lit(False)) if max_chars is None else (
        F.substring("_clean", 1, max_chars), F.length("_clean") > max_chars)
    staged = with_once(df, _full=F.coalesce(full_text, F.lit("")))
    return (with_once(staged, _clean=clean_body(F.col("_full")))
            .withColumns({"body_excerpt": excerpt, "body_sha256": F.sha2("_full", 256), "truncated": cut})
            .drop("_full", "_clean"))


# --- paragraph predicates -------------------------------------------------------------------------------------


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rx(r"\n\s*\n"), -1), strip), lambda p: F.length(p) > 0)


def has_date_shape(text: Column) -> Column:
    def shaped(t: Column, plain: bool) -> Column:
        if not plain:
            return matches(t, lx.DATE_SHAPE, "i")
        return t.rlike(r"\d") & (t.rlike(lx.DATE_SHAPE_DIGITS) | (t.rlike(lx.MONTH_NAME) & matches(t, lx.DATE_SHAPE_MONTHS, "i", plain)))

    return by_script(text, shaped)


def has_time_shape(text: Column) -> Column:
    return by_script(text, lambda t, plain: F.contains(t, F.lit(":")) & t.rlike(lx.TIME_SHAPE_DIGITS) if plain else matches(t, lx.TIME_SHAPE))


def is_footnote(paragraph: Column) -> Column:
    """A note or disclaimer paragraph: its dates are no events. Expects a trimmed paragraph."""
    marker = paragraph.rlike("^(?:" + "|".join("\\" + m if m in "*^" else m for m in lx.FOOTNOTE_MARKERS) + ")")
    hint = contains_any(F.lower(paragraph), lx.DISCLAIMER_HINTS)
    return marker | (hint & (F.length(paragraph) < 200))
