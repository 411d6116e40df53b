"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailspark.llm import collocations
from tests.llm import samples

TABLE = "doc_id long, text string, lang string, phrase string, n string, size string, rank string"


def pieces(text: str | None) -> list[list[bytes]]:
    return [re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0A-\x0D]", samples.lowered(text))]


def plain(rows, support, covered=100, first=2000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        often = {p: a for (of, p), a in f.items() if of == lang and len(p) > 1 and a >= support}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        scores = []
        for p, a in often.items():
            if 100 * inside[p] >= covered * a:
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            scores.append((-s, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scores)[:first], 1)]
    return sorted(out)


def rows_of(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "éa", "Ü", "a-b", "x", "new york", "one two three four five six", "\tq "]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", ", ", "\n", ". ", "\x0b", "?!"]) for _ in range(rng.choice([0, 1, 9, 60])))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "de"), (None, None), (" .,\n", "fr"), ("a b a b a b a b a b " * 3000, "en"), rows[0], rows[0],
                   ("alone", "es")] + [("hot line of words here", "en")] * 60


def got(spark, rows, **options):
    table = spark.createDataFrame([(k, *r, "p", "n", "s", "r") for k, r in enumerate(rows)], TABLE).repartition(5)
    found = collocations.collocations(table, **options)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"shard": 50}, {"shard": 500, "travel": 0}, {"travel": 0}])
def test_equals_plain_counting(spark, options):
    rows = rows_of()
    want = plain(rows, 10)
    assert len({r[0] for r in want}) == 3 and len(want) > 30
    assert got(spark, rows, support=10, **options) == want


def test_options(spark):
    rows = rows_of(5)
    assert got(spark, rows, support=4, covered=60, first=15, longest=4) == plain(rows, 4, 60, 15, 4)
    assert got(spark, rows, support=1_000_000) == [] and got(spark, []) == [] and got(spark, [(None, None), ("", "x")]) == []


def test_marks_of_a_small_bitmap_lose_nothing(spark):
    rows = rows_of(6)
    docs = collocations.texts_of(spark.createDataFrame(rows, "text string, lang string").repartition(6))
    totals = collocations.word_counts(docs)
    wanted = collocations.candidates(collocations.mined(docs, totals, 10, shard=200, room=500), 10).cache()
    same = [sorted((r.key, r.n) for r in f.collect() if r.n)
            for f in (collocations.counted(docs, wanted, block=3), collocations.joined(docs, wanted, bits=4), collocations.joined(docs, wanted))]
    assert same[0] == same[1] == same[2] and len(same[0]) > 20


def test_shards_name_every_frequent_phrase(spark):
    """What the shards call frequent, with what the others may hide, bounds every count."""
    rows = rows_of(7)
    docs = collocations.texts_of(spark.createDataFrame(rows, "text string, lang string").repartition(12))
    totals = collocations.word_counts(docs)
    assert {(r.lang, r.n) for r in totals.collect() if r.n} == {
        (lang, sum(len(w) for t, of in rows if (of or "und") == lang for w in pieces(t))) for lang in ("en", "de", "und", "es")}
    local = collocations.mined(docs, totals, 20, shard=300, room=1000).cache()
    assert local.where("bucket = 0 and lang = 'en'").count() == 12 and local.where("bucket > 0").count() > 0
    assert local.where("exists(n, x -> x < least)").isEmpty() and local.where("least > 1").count() > 0
    named = {tuple(r.parts) for r in collocations.candidates(local, 20).collect()}
    size = {}
    for t, lang in rows:
        for w in pieces(t):
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    size[lang or "und", tuple(w[i:i + m])] = size.get((lang or "und", tuple(w[i:i + m])), 0) + 1
    assert len(named) >= sum(n >= 20 for n in size.values())


def test_no_shard_is_a_small_rest():
    texts = pa.array([f"a{k} b c" for k in range(400)])
    held, sizes = collocations.Shard(50), []
    held.numbers(["en"])
    for found in collocations.words(texts, np.zeros(400, np.int64), collocations.language_salts(["en"]), 30):
        if full := held.add(found):
            sizes.append(sum(len(w.start) for w in full))
    assert sum(sizes) + held.size == 1200 and all(50 <= n < 100 for n in sizes) and 50 <= held.size < 110


def test_mining_takes_little_memory_a_word():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 40_000, 1000)) for _ in range(400)])
    held = collocations.Shard(1 << 22)
    number = held.numbers(["en"])[np.zeros(400, np.int64)]
    for found in collocations.words(texts, number, collocations.language_salts(["en"])):
        held.add(found)
    tracemalloc.start()
    assert sum(len(found.n) for _, _, found in held.mined(held.held, {"en": 400_000}, 100, 5)) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * 400_000


def test_scores_past_64_bits(spark):
    many = 3 * 10 ** 12
    phrases = spark.createDataFrame([("en", "a", 1, many), ("en", "b", 1, many), ("en", "a b", 2, many - 1)],
                                    "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 10 ** 13)], "lang string, n long")
    found = collocations.scored(phrases, totals).collect()
    assert [r.score for r in found] == [1000 * (many - 1) * 10 ** 13 // many ** 2]


def test_words_break_like_the_pattern():
    texts = ["A b,c\td", None, "", ",,", "é.É x\x0by z\rq", "w" * 50 + " v"]
    for size in (1, 9, 1 << 20):
        out = []
        for found in collocations.words(pa.array(texts), np.zeros(len(texts), np.int64), collocations.language_salts(["en"]), size):
            groups: dict = {}
            for a, b, p in zip(found.start, found.end, found.piece):
                groups.setdefault(p, []).append(bytes(found.data[a:b]))
            out += groups.values()
        assert out == [w for t in texts for w in pieces(t) if w]
