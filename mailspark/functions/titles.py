"""Event titles derived from the sentence that names the time, else from the subject."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import by_script, fold_spaces, let, matches, nonempty, rx, strip, sub

_ANY_TIME = "|".join(f"(?:{p})" for p in lx.TITLE_STRIP)
_ANY_TIME_ASCII = "|".join(f"(?:{p})" for p in (
    lx.DATE_YMD, lx.TIME_COLON, lx.TIME_EN, lx.DATE_EN_MDY, lx.DATE_EN_DMY, lx.DATE_EN_MD, lx.DATE_EN_DM))
_RELATIVE = "|".join(word for word, _ in lx.RELATIVE_DAYS)
_DANGLING_TAIL = rf"(?:\s*(?:{lx.TITLE_DANGLING_WORDS}))+\s*\z"


# of the patterns above, those that can match in ASCII text, and those that need a month name
_ASCII_STRIP = (lx.DATE_YMD, lx.TIME_COLON, lx.TIME_EN)
_MONTH_STRIP = (lx.DATE_EN_MDY, lx.DATE_EN_DMY, lx.DATE_EN_MD, lx.DATE_EN_DM)
_MONTH = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def clean_fragment(text: Column) -> Column:
    """Drop time expressions, connectives and what is left hanging around them."""
    return by_script(text, lambda t, plain: _clean_ascii(t) if plain else _clean_any(t))


def _clean_any(text: Column) -> Column:
    text = sub(text, lx.TITLE_PREPOSITION, " ")
    for pattern in (*lx.TITLE_STRIP, _RELATIVE, lx.TITLE_BARE_MERIDIEM):
        text = sub(text, pattern, " ")
    text = sub(text, lx.TITLE_LEAD)
    text = sub(text, lx.TITLE_CONNECTIVE, " ")
    text = sub(text, lx.TITLE_DANGLING_HEAD)
    text = sub(text, lx.TITLE_EMPTY_BRACKETS, " ")
    text = fold_spaces(sub(text, lx.TITLE_GAP, " "))
    text = sub(text, lx.TITLE_TAIL)
    return strip(sub(text, _DANGLING_TAIL))


def _clean_ascii(text: Column) -> Column:
    """The same steps without those that no ASCII text can take."""
    def replaced(value: Column, patterns: tuple[str, ...]) -> Column:
        for pattern in patterns:
            value = sub(value, pattern, " ", plain=True)
        return value

    words = "today|tomorrow"
    text = replaced(text, (lx.TITLE_PREPOSITION, *_ASCII_STRIP))
    text = let(text, lambda t: F.when(t.rlike(_MONTH), replaced(t, _MONTH_STRIP)).otherwise(t))
    text = replaced(text, (words, lx.TITLE_BARE_MERIDIEM, r"[(\[][\s|\-,]*+[)\]]", r"[\s,.;:]{2,}", r"\s+"))
    return F.trim(F.regexp_replace(F.trim(text), r"[\s,.;:!?]+$", ""))


def looks_like_title(text: Column) -> Column:
    return (F.length(text) >= 4) & ~text.rlike(r"(?U)[\s，,。．.；;：:、！!？?]$") & ~matches(text, _DANGLING_TAIL)


def strip_subject_decor(text: Column) -> Column:
    return strip(sub(text, rf"^(?:\s*(?:{lx.SUBJECT_DECOR})\s*)+", "", "i"))


def subject_title(subject: Column) -> Column:
    """The subject without machine marks and dates; null when nothing readable is left."""
    text = strip_subject_decor(clean_fragment(strip_subject_decor(strip(subject))))
    return let(text, lambda t: F.when(looks_like_title(t), F.when(
        F.length(t) > lx.TITLE_MAX_CHARS,
        F.concat(F.rtrim(F.substring(t, 1, lx.TITLE_MAX_CHARS)), F.lit("…"))).otherwise(t)))


def time_sentence(paragraph: Column) -> Column:
    """The first sentence with a time expression, else the whole paragraph."""
    sentences = F.filter(F.transform(F.split(paragraph, "[。！？!?；;\n]+"), strip), lambda s: F.length(s) > 0)
    def timed(found: Column) -> Column:
        # a sentence without digits, numerals, weekday or month words cannot hold a time
        return by_script(found, lambda s, plain: s.rlike(r"\d" if plain else r"[\d月周週星礼禮时時點点]|[０-９]") & s.rlike(
            rx(_ANY_TIME_ASCII if plain else _ANY_TIME, plain=plain)))

    return F.coalesce(F.get(F.filter(sentences, timed), F.lit(0)), strip(paragraph))


def choose_title(fragment: Column, from_subject: Column, subject: Column) -> Column:
    """struct(title, title_from_subject) out of the cleaned sentence and the cleaned subject."""
    fallback = F.coalesce(from_subject, nonempty(subject), F.lit(lx.NO_TITLE))
    long = F.length(fragment) > lx.TITLE_MAX_CHARS
    shortened = F.concat(F.rtrim(F.substring(fragment, 1, lx.TITLE_MAX_CHARS)), F.lit("…"))
    readable = looks_like_title(fragment)
    return F.struct(
        F.when(~readable, fallback).when(long, F.coalesce(from_subject, shortened)).otherwise(fragment).alias("title"),
        (~readable | (long & from_subject.isNotNull())).alias("title_from_subject"))
