"""Scans of texts that leave out what no ASCII text can hold find the same as the scans of any text."""

import random
import re

from pyspark.sql import functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import contains_any, matches, strip, sub, words_found
from mailspark.functions.dates import dates_in, may_hold_date
from mailspark.functions.text import has_date_shape, has_time_shape

PIECES = ["2026-03-04", "2026/3/4", "2026 - 3 . 4", "3月4日", "2026年3月4日", "三月四日", "Mar 4", "4th of", "4th  March", "MAY 2026", "sept. 3", "summary 3",
          "8:30", "18:05", "8点", "下午 3", "99:9", "today", "ToMorrow", "明天", "周三", "meeting", "截止", "due", "otp", "约", "around", " ", "\t",
          "\n\n", "  ", "é", "１２", "ſep 3", "K", "1234", "12", ".", "unsubscribe", "退订", "\x1c", "\x0b"]


def texts():
    rng = random.Random(2)
    some = ["", " ", "x", *PIECES, *("".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(2, 7))) for _ in range(400))]
    return [(k, t) for k, t in enumerate([*some, None])]


def test_scans_equal_the_patterns_of_any_text(spark):
    t, day = F.col("t"), F.lit("2026-01-05").cast("date")
    gate = (r"(?iU)\d{4}|月|周|週|星期|礼拜|禮拜|" + "|".join(w for w, _ in lx.RELATIVE_DAYS)
            + r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
    any_of = lambda words: t.rlike("|".join(re.escape(w) for w in words))
    pairs = {
        "date": (has_date_shape(t), matches(t, lx.DATE_SHAPE, "i")), "time": (has_time_shape(t), matches(t, lx.TIME_SHAPE)),
        "gate": (may_hold_date(t), t.rlike(gate)), "strip": (strip(t), sub(t, r"^\s+|\s+\z")),
        "deadline": (contains_any(t, lx.DEADLINE_KEYWORDS), any_of(lx.DEADLINE_KEYWORDS)),
        "vague": (contains_any(t, lx.VAGUE_WORDS), any_of(lx.VAGUE_WORDS)), "cjk": (contains_any(t, ("退订",)), any_of(("退订",))),
        "dates": (dates_in(t, day), dates_in(F.concat(F.lit("é "), t), day))}
    df = spark.createDataFrame(texts(), "k long, t string")
    for name, (mine, theirs) in pairs.items():
        wrong = df.select("t", mine.alias("a"), theirs.alias("b")).where("NOT a <=> b").collect()
        assert wrong == [], name
    lists = (lx.EVENT_KEYWORDS, lx.NOISE_KEYWORDS, lx.MARKETING_KEYWORDS)
    for r in df.select("t", *[words_found(t, words).alias(f"w{k}") for k, words in enumerate(lists)]).where("t IS NOT NULL").collect():
        assert [r.w0, r.w1, r.w2] == [[w for w in words if w in r.t] for words in lists]


def test_ascii_is_told_without_a_pattern(spark):
    plan = spark.range(1).select(has_time_shape(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "x7f" not in plan
