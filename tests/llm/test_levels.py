"""Phrases mined by shards that meet after each level."""

from __future__ import annotations

from collections import Counter

import pytest

from mailspark.llm import collocations
from tests.llm.test_collocations import got, pieces, plain, rows_of


@pytest.mark.parametrize("options", [{"shard": 50, "least": 1_000}, {"least": 1 << 40}, {"shard": 50, "least": 0}, {"shard": 500, "travel": 0, "least": 0}])
def test_both_ways_equal_plain_counting(spark, options):
    rows = rows_of()
    want = plain(rows, 10)
    assert len(want) > 30 and got(spark, rows, support=10, **options) == want


def test_levels_of_odd_tables(spark):
    rows = rows_of(5)
    assert got(spark, rows, support=4, covered=60, first=15, longest=4, least=1 << 40) == plain(rows, 4, 60, 15, 4)
    assert got(spark, rows, support=1_000_000, shard=1, least=1 << 40) == []


def test_shards_of_a_large_input_name_only_what_is_built_on_frequent_phrases(spark):
    """With a support share of 1, a shard that is mined alone names every phrase it has."""
    rows = [(f"a b x{k} y{k} z{k} a b", "en") for k in range(300)]
    docs = collocations.texts_of(spark.createDataFrame(rows, "text string, lang string").repartition(6))
    totals = collocations.word_counts(docs)
    named = collocations.mined(docs, totals, 5, shard=100).selectExpr("sum(size(key)) as n").first().n
    assert named > 3_000
    found = {r.key: (r.lang, r.size, r.n, r.text) for r in collocations.in_levels(docs, 2100, 5, shard=100, bits=16).collect()}
    assert sorted(found.values(), key=repr) == sorted([("en", 1, 600, "a"), ("en", 1, 600, "b"), ("en", 2, 600, None)], key=repr)
    second = collocations.level(docs, 2, collocations.level(docs, 1, None, 5, 3, 100), 1, 3, 100).collect()
    assert [r.n for r in second] == [600]  # no window with a rare word was named


def test_small_marks_change_no_count(spark):
    rows = rows_of(6)
    docs = collocations.texts_of(spark.createDataFrame(rows, "text string, lang string").repartition(6))
    count = Counter()
    for text, lang in rows:
        for w in pieces(text):
            count.update((lang or "und", m) for m in range(1, 6) for _ in range(len(w) - m + 1))
    want, mine = [sorted((r.lang, r.size, r.key, r.n) for r in collocations.in_levels(docs, 60_000, 10, shard=300, room=700, bits=bits).collect()) for bits in (27, 4)]
    assert want == mine and len(want) > 20 and all(n <= count[lang, size] for lang, size, _, n in want)


def test_every_phrase_is_told_by_few_places(spark):
    rows = [("a b c a b", "en")] * 4000 + [("d e", "de")] * 20
    docs = collocations.texts_of(spark.createDataFrame(rows, "text string, lang string").repartition(6))
    found = collocations.in_levels(docs, 20_040, 20, shard=300)
    assert sorted((r.lang, r.size, r.n) for r in found.collect()) == sorted([
        ("en", 1, 8000), ("en", 1, 8000), ("en", 1, 4000), ("en", 2, 8000), ("en", 2, 4000), ("en", 2, 4000), ("en", 3, 4000), ("en", 3, 4000),
        ("en", 3, 4000), ("en", 4, 4000), ("en", 4, 4000), ("en", 5, 4000), ("de", 1, 20), ("de", 1, 20), ("de", 2, 20)])
    for times in (0, 1, 6):  # with 0 the drawn places tell nothing
        again = collocations.spelled(docs, found.select("size", "key", "n"), times=times)
        assert sorted((r.key, r.lang, tuple(r.parts), r.text) for r in again.collect()) == sorted((r.key, r.lang, tuple(r.parts), r.text) for r in found.collect())
