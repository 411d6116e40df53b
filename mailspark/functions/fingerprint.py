"""Identity of events: normal forms, fingerprints and the title similarity used for hints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from mailspark import lexicon as lx
from mailspark.functions.common import casefold, fold_spaces, strip, sub

CJK = "[一-鿿]"
SEPARATOR = "\u001f"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility normal form. Plain ASCII never leaves the JVM: the Arrow batch carries nulls for it."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(ascii_only, text), _nfkc(F.when(~ascii_only, text)))


def normalize_title(title: Column) -> Column:
    """Decorations and stacked reply prefixes removed, spaces folded, case folded."""
    text = F.coalesce(title, F.lit(""))
    text = nfkc(text)
    text = F.translate(text, "​﻿", "")
    text = sub(text, rf"^(?:\s*(?:{lx.TITLE_PREFIX})\s*)+", "", "i")
    return casefold(fold_spaces(text))


def normalize_ts_text(value: Column) -> Column:
    """A stamp cut to the minute without any zone conversion."""
    text = F.replace(strip(F.coalesce(value, F.lit(""))), F.lit("T"), F.lit(" "))
    minute = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1)
    other = F.regexp_replace(text, r"([+-]\d{2}):?(\d{2})$", "$1$2")
    return F.when(F.length(minute) > 0, minute).otherwise(other)


def normalize_identity(value: Column) -> Column:
    text = casefold(strip(F.coalesce(value, F.lit(""))))
    inner = F.regexp_extract(text, "<([^>]+)>", 1)
    return F.when(F.length(inner) > 0, strip(inner)).otherwise(text)


def normalize_location(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return casefold(fold_spaces(nfkc(text)))


def short_sha(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def event_fingerprint(title: Column, start_ts: Column, end_ts: Column, organizer: Column, location: Column) -> Column:
    """Content identity of an event; start and end are instants."""
    return short_sha(normalize_title(title), minute_text(start_ts), minute_text(end_ts),
                     normalize_identity(organizer), normalize_location(location))


def ics_fingerprint(uid: Column, recurrence_id: Column, organizer: Column) -> Column:
    """Identity of a calendar entry: stable when its summary or time is updated; null without a uid."""
    return F.when(F.length(uid) > 0, short_sha(
        strip(uid), strip(F.coalesce(recurrence_id, F.lit(""))), normalize_identity(organizer)))


def title_tokens(title: Column) -> Column:
    """Words of three letters and more; CJK words as two-character windows. Distinct, in order."""
    text = F.coalesce(title, F.lit(""))
    text = casefold(nfkc(text))
    words = F.split(F.trim(F.regexp_replace(text, "[^0-9a-z一-鿿]+", " ")), " ")

    def tokens(word: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1)),
                              lambda i: word.substr(i, F.lit(2)))
        return (F.when(word.rlike(CJK), windows)
                .when(F.length(word) >= 3, F.array(word))
                .otherwise(F.expr("cast(array() as array<string>)")))

    return F.array_distinct(F.flatten(F.transform(words, tokens)))


def overlap(left: Column, right: Column) -> Column:
    """Shared tokens over the size of the smaller set; 0 when either is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def title_similarity(left: Column, right: Column) -> Column:
    return overlap(title_tokens(left), title_tokens(right))
