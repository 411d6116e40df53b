"""Small column helpers used by every other function module."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F


def rx(pattern: str, flags: str = "", plain: bool = False) -> str:
    """A Java pattern whose \\d, \\s, \\w and \\b follow Unicode, as the fixed patterns expect.

    ``plain`` leaves the slower Unicode classes off: on ASCII text both read the same.
    """
    mode = flags if plain else f"U{flags}"
    return f"(?{mode}){pattern}" if mode else pattern


def by_script(text: Column, make: Callable[[Column, bool], Column]) -> Column:
    """``make(text, plain)`` with plain patterns for ASCII text and Unicode ones for all other text."""
    return let(text, lambda t: F.when(is_ascii(t), make(t, True)).otherwise(make(t, False)))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: two counts, where a pattern would look at every character. Broken bytes count as
    ASCII: they are read as U+FFFD, which plain and Unicode classes take alike."""
    return F.octet_length(text) == F.length(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns that are computed once per row.

    Catalyst pushes a filter on a computed column below its projection by repeating the expression; it does not
    do so across a generator. Filters on these columns therefore run on their values.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def sub(col: Column, pattern: str, replacement: str = "", flags: str = "", plain: bool = False) -> Column:
    return F.regexp_replace(col, rx(pattern, flags, plain), replacement)


def matches(col: Column, pattern: str, flags: str = "", plain: bool = False) -> Column:
    return col.rlike(rx(pattern, flags, plain))


def find_all(col: Column, pattern: str, group: int = 0, plain: bool = False) -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, plain=plain)), F.lit(group))


def strip(col: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return by_script(col, lambda t, plain: F.btrim(t, F.lit(" \t\n\x0b\f\r")) if plain else sub(t, r"^\s+|\s+\z"))


def fold_spaces(col: Column) -> Column:
    return strip(sub(col, r"\s+", " "))


def casefold(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def nonempty(col: Column) -> Column:
    """The value, or null for an empty string."""
    return F.when(F.length(col) > 0, col)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """Whether some word of a list occurs (substring match). Words that no ASCII text can hold are not looked for there."""
    words = list(dict.fromkeys(words))
    return by_script(col, lambda t, plain: reduce(or_, [F.contains(t, F.lit(w)) for w in words if w.isascii() or not plain], F.lit(False)))


def literal_list(values: Iterable[str]) -> Column:
    """A constant array, folded by the optimizer out of one literal. Values must not hold a line feed."""
    return F.split(F.lit("\n".join(values)), "\n")


def words_found(lowered: Column, words: Iterable[str]) -> Column:
    """The list members that occur in an already lowered text, in list order (repeats in the list are kept)."""
    words = list(words)

    def found(text: Column, plain: bool) -> Column:
        some = [w for w in words if w.isascii() or not plain]
        return F.filter(literal_list(some), lambda w: F.contains(text, w)) if some else F.expr("cast(array() as array<string>)")

    return by_script(lowered, found)


def join_nonempty(separator: str, *cols: Column) -> Column:
    """concat_ws that also skips empty strings."""
    return F.concat_ws(separator, *[nonempty(c) for c in cols])


def local_time(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO text to an instant; a stamp without a zone is read as UTC, broken text gives null."""
    return F.try_to_timestamp(text)


def flag(condition: Column) -> Column:
    """A condition as 0/1, with null read as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
