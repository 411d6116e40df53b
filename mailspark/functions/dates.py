"""Dates and clock times found in a paragraph, as arrays in reading order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import by_script, find_all, let, literal_list, matches, nonempty, rx, strip

_WIDE_DIGITS = "０１２３４５６７８９"


def _no_dates() -> Column:
    return F.expr("cast(array() as array<struct<day:date,has_year:boolean,ev:string>>)")


def _no_times() -> Column:
    return F.expr("cast(array() as array<struct<h:int,mi:int,ev:string>>)")


def to_int(digits: Column) -> Column:
    return nonempty(F.translate(digits, _WIDE_DIGITS, "0123456789")).cast("int")


def _cn_digits(text: Column) -> Column:
    return F.translate(text, "".join(lx.CN_NUMERALS), "".join(lx.CN_NUMERALS.values()))


def cn_number(text: Column) -> Column:
    """1 to 99 in Chinese numerals: tens notation, or digits read one by one; null when malformed."""
    def value(digits: Column) -> Column:
        # "十" alone reads as "1十0"
        full = F.regexp_replace(F.regexp_replace(digits, r"^十", "1十"), r"十$", "十0")
        return F.when(full.rlike(r"^\d十\d$"), F.replace(full, F.lit("十"), F.lit("")).cast("int")).when(
            digits.rlike(r"^\d{1,2}$"), digits.cast("int"))

    return let(_cn_digits(text), value)


def cn_year(text: Column) -> Column:
    digits = _cn_digits(text)
    return nonempty(F.regexp_extract(digits, r"^(?:19|2\d)\d\d$", 0)).cast("int")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The calendar date, or null when there is no such day."""
    dash = F.lit("-")
    return F.concat(_padded(year, 4), dash, _padded(month, 2), dash, _padded(day, 2)).try_cast("date")


def infer_year(month: Column, day: Column, received: Column) -> Column:
    """A month and day without a year: this year unless more than 30 days gone, else the next.

    A day missing in the year of receipt (29 February) gives null, never the next year.
    """
    def in_year(year: Column, tail: Column) -> Column:
        return F.concat(_padded(year, 4), tail).try_cast("date")

    dash = F.lit("-")
    return let(F.concat(dash, _padded(month, 2), dash, _padded(day, 2)), lambda tail: let(
        in_year(F.year(received), tail), lambda this: F.when(this >= F.date_sub(received, 30), this).when(
            this.isNotNull(), in_year(F.year(received) + 1, tail))))


def month_number(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    order = [m for m in lx.EN_MONTHS if len(m) == 3]
    return F.array_position(F.array(*[F.lit(m) for m in order]), short).cast("int")


def _family(text: Column, pattern: str, day_of, has_year: bool, plain: bool = False) -> Column:
    """All valid dates one pattern finds, with the text that shows them."""
    def part(match: Column, group: int) -> Column:
        return F.regexp_extract(match, rx(pattern, plain=plain), group)

    hits = F.transform(find_all(text, pattern, plain=plain), lambda m: F.struct(
        day_of(lambda g: part(m, g)).alias("day"), F.lit(has_year).alias("has_year"), strip(m).alias("ev")))
    return F.filter(hits, lambda h: h["day"].isNotNull())


def relative_date(text: Column, received: Column, plain: bool = False) -> Column:
    """struct(day, has_year, ev) for today/tomorrow words or a weekday, else null. ``plain``: of an ASCII text."""
    def found(day: Column, evidence: Column) -> Column:
        return F.struct(day.alias("day"), F.lit(True).alias("has_year"), evidence.alias("ev"))

    # the first word of the list that occurs, with the days it adds
    known = [(word, delta) for word, delta in lx.RELATIVE_DAYS if word.isascii() or not plain]
    words = literal_list(word for word, _ in known)
    deltas = F.array(*[F.lit(delta) for _, delta in known])
    first = let(F.lower(text), lambda t: F.get(F.filter(words, lambda w: F.contains(t, w)), F.lit(0)))

    def by_word(word: Column) -> Column:
        return F.when(word.isNotNull(), found(
            F.date_add(received, F.get(deltas, F.array_position(words, word).cast("int") - 1)), word))

    def by_weekday(evidence: Column) -> Column:
        before = F.regexp_extract(text, rx(rf"^([\s\S]*?)(?:{lx.WEEKDAY_WORD})"), 1)
        scope = F.regexp_extract(evidence, rx(lx.WEEKDAY_WORD), 1)
        digit = F.regexp_extract(evidence, rx(lx.WEEKDAY_WORD), 2)
        return F.when((F.length(evidence) > 0) & let(before, lambda b: ~inside_brackets(b)),
                      found(weekday_date(digit, scope, received), strip(evidence)))

    if plain:  # weekday words are never ASCII
        return let(first, by_word)
    weekday = F.when(text.rlike("周|週|星期|礼拜|禮拜"), let(
        F.regexp_extract(text, rx(lx.WEEKDAY_WORD), 0), by_weekday))
    return F.coalesce(let(first, by_word), weekday)


def weekday_date(digit: Column, scope: Column, received: Column) -> Column:
    """The day a weekday word means, counted from the day of receipt."""
    names, numbers = "".join(lx.WEEKDAY_DIGITS), "".join(str(n) for n in lx.WEEKDAY_DIGITS.values())
    target = F.translate(digit, names, numbers).cast("int")
    ahead = F.pmod(target - F.weekday(received), F.lit(7))
    shift = (F.when(scope.isin(*lx.NEXT_WEEK_SCOPES), ahead + 7)
             .when(scope.isin(*lx.THIS_WEEK_SCOPES), ahead)
             .when(ahead == 0, F.lit(7)).otherwise(ahead))
    return F.date_add(received, shift.cast("int"))


def inside_brackets(before: Column) -> Column:
    """Whether the text up to a match leaves a bracket open."""
    def count(mark: str) -> Column:
        return F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit("")))

    condition = F.lit(False)
    for left, right in lx.BRACKET_PAIRS:
        condition = condition | (count(left) > count(right))
    return condition


def may_hold_date(text: Column) -> Column:
    """Cheap gate: false means that no date family can match."""
    words = "|".join(word for word, _ in lx.RELATIVE_DAYS)

    def held(t: Column, plain: bool) -> Column:
        if not plain:
            return t.rlike(r"(?iU)\d{4}|月|周|週|星期|礼拜|禮拜|" + words +
                           r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
        return t.rlike(r"\d{4}") | t.rlike(lx.MONTH_NAME) | t.rlike("(?i)" + "|".join(w for w, _ in lx.RELATIVE_DAYS if w.isascii()))

    return by_script(text, held)


def dates_in(text: Column, received: Column) -> Column:
    """Every date of the first pattern family that yields a valid one."""
    return by_script(text, lambda t, plain: _dates(t, received, plain))


def _dates(text: Column, received: Column, plain: bool) -> Column:
    has_month_sign = F.contains(text, F.lit("月"))
    has_month_name = matches(text, r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", "i", plain)

    def gated(gate: Column, dates: Column) -> Column:
        return F.when(gate, dates).otherwise(_no_dates())

    numeric = _family(text, lx.DATE_YMD, lambda g: safe_date(to_int(g(1)), to_int(g(2)), to_int(g(3))), True, plain)
    families = [numeric] if plain else [
        gated(has_month_sign, _family(text, lx.DATE_CN_NUMERAL, lambda g: safe_date(
            cn_year(g(1)), cn_number(g(2)), cn_number(g(3))), True)),
        numeric,
        gated(has_month_sign, _family(text, lx.DATE_CN_NUMERAL_NO_YEAR, lambda g: infer_year(
            cn_number(g(1)), cn_number(g(2)), received), False)),
        gated(F.contains(text, F.lit("日")), _family(text, lx.DATE_MD_NO_YEAR, lambda g: infer_year(
            to_int(g(1)), to_int(g(2)), received), False)),
    ]
    families += [
        gated(has_month_name, F.concat(
            _family(text, lx.DATE_EN_MDY, lambda g: safe_date(
                to_int(g(3)), month_number(g(1)), to_int(g(2))), True, plain),
            _family(text, lx.DATE_EN_DMY, lambda g: safe_date(
                to_int(g(3)), month_number(g(2)), to_int(g(1))), True, plain))),
        gated(has_month_name, F.concat(
            _family(text, lx.DATE_EN_MD, lambda g: infer_year(
                month_number(g(1)), to_int(g(2)), received), False, plain),
            _family(text, lx.DATE_EN_DM, lambda g: infer_year(
                month_number(g(2)), to_int(g(1)), received), False, plain))),
        F.filter(F.array(relative_date(text, received, plain)), lambda r: r.isNotNull()),
    ]
    def first_of(some: list[Column]) -> Column:
        """A family is looked for only where those before it found nothing."""
        return let(some[0], lambda f: F.when(F.size(f) > 0, f).otherwise(first_of(some[1:]))) if some else _no_dates()

    return first_of(families)


# --- clock times ----------------------------------------------------------------------------------------------

_TIME_ASCII = "|".join(f"(?:{p})" for p in (lx.TIME_EN, lx.TIME_COLON))
_TIME_ANY = "|".join(f"(?:{p})" for p in (lx.TIME_EN, lx.TIME_CN_NUMERAL, lx.TIME_CN, lx.TIME_COLON))


def apply_period(hour: Column, period: Column) -> Column:
    """Day-period words on a 12-hour clock. Noon adds 12 to 1..3 only, so 11 at noon stays 11."""
    return let(hour, lambda h: (
        F.when(period.isin(*lx.AFTERNOON_PERIODS) & (h < 12), h + 12)
        .when((period == "中午") & h.between(1, 3), h + 12)
        .when((period == "凌晨") & (h == 12), F.lit(0)).otherwise(h)))


def apply_meridiem(hour: Column, marker: Column) -> Column:
    mark = F.lower(F.replace(marker, F.lit("."), F.lit("")))
    return let(hour, lambda h: (
        F.when((mark == "pm") & (h < 12), h + 12).when((mark == "am") & (h == 12), F.lit(0)).otherwise(h)))


def times_in(text: Column) -> Column:
    """Distinct clock times in reading order. One scan finds all forms; the longest form wins at a position."""
    return by_script(text, _times)


def _times(text: Column, plain: bool) -> Column:
    def time_of(match: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_extract(match, rx(pattern, plain=plain), group)

        is_en = matches(match, r"(?:am|pm|a\.m\.|p\.m\.)$", "i", plain)
        if plain:
            return F.struct(
                F.when(is_en, apply_meridiem(to_int(part(lx.TIME_EN, 1)), part(lx.TIME_EN, 3))).otherwise(
                    to_int(part(lx.TIME_COLON, 1))).cast("int").alias("h"),
                F.coalesce(F.when(is_en, to_int(part(lx.TIME_EN, 2))).otherwise(to_int(part(lx.TIME_COLON, 2))),
                           F.lit(0)).cast("int").alias("mi"), strip(match).alias("ev"))
        is_colon = F.contains(match, F.lit(":")) & ~is_en
        is_numeral = matches(match, rf"[{lx.CN_NUM_CLASS}]\s*[时時點点]")
        hour = (F.when(is_en, apply_meridiem(to_int(part(lx.TIME_EN, 1)), part(lx.TIME_EN, 3)))
                .when(is_colon, to_int(part(lx.TIME_COLON, 1)))
                .when(is_numeral, apply_period(cn_number(part(lx.TIME_CN_NUMERAL, 2)), part(lx.TIME_CN_NUMERAL, 1)))
                .otherwise(apply_period(to_int(part(lx.TIME_CN, 2)), part(lx.TIME_CN, 1))))
        cn_minute = part(lx.TIME_CN_NUMERAL, 3)
        minute = (F.when(is_en, F.coalesce(to_int(part(lx.TIME_EN, 2)), F.lit(0)))
                  .when(is_colon, to_int(part(lx.TIME_COLON, 2)))
                  .when(is_numeral, F.when(F.length(cn_minute) > 0, cn_number(cn_minute)).otherwise(F.lit(0)))
                  .otherwise(F.coalesce(to_int(part(lx.TIME_CN, 3)), F.lit(0))))
        return F.struct(hour.cast("int").alias("h"), minute.cast("int").alias("mi"), strip(match).alias("ev"))

    found = F.filter(F.transform(find_all(text, _TIME_ASCII if plain else _TIME_ANY, plain=plain), time_of),
                     lambda t: t["h"].between(0, 23) & t["mi"].between(0, 59))
    first_of_each = let(found, lambda times: F.filter(times, lambda t, i: F.array_position(
        F.transform(times, lambda u: u["h"] * 60 + u["mi"]), t["h"] * 60 + t["mi"]) == i + 1))
    gate = rx(r":|\d\s*[ap]\.?m" if plain else r"[时時點点:]|\d\s*[ap]\.?m", "i", plain)
    return F.when(text.rlike(gate), first_of_each).otherwise(_no_times())
