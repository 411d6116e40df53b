"""Rows that repeat an id, or have none: nothing is lost, nothing multiplies."""

from __future__ import annotations

import random

import pytest

from mailspark.llm import language, templates
from tests.llm.test_operators import ITEMS

LEAK = "Noise. Peter has 15 apples and gives 7 kg of them to Susan before lunch. How many apples does Peter have left? tail"
DOCS = "doc_id long, text string, _held long, doc string, item string"


@pytest.mark.parametrize("travel", [templates.TRAVEL, 0])
def test_a_leak_takes_its_own_row_only(spark, travel):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, LEAK), (None, "clean words of no item at all"), (None, "others, as clean"), (7, LEAK), (7, "clean again"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, 1, "d", "i") for r in rows], DOCS)
    kept = templates.without_leaks(docs, items, travel=travel)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "clean words of no item at all"), (0, "others, as clean"), (7, ""), (7, "clean again"), (8, "")]
    found = templates.leaks(docs.select("doc_id", "text"), items, travel=travel)
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, 1), (7, 1)]


def test_texts_of_one_id_do_not_add_up(spark):
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gum", "hazel", "ivy", "juniper", "kauri", "larch", "maple", "nutmeg", "oak", "pine"]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    halves = [(3, " ".join(words[:8]) + " x y z"), (3, "p q r " + " ".join(words[8:])), (None, " ".join(words[:8])), (None, " ".join(words[8:]))]
    docs = spark.createDataFrame(halves, "doc_id long, text string")
    assert templates.leaks(docs, items).isEmpty()
    twice = spark.createDataFrame([(1, " ".join(words[:8])), (1, " ".join(words[8:]))], "item_id long, text string")
    whole = spark.createDataFrame([(5, " ".join(words[:4] + words[12:]))], "doc_id long, text string")
    assert templates.leaks(whole, twice).isEmpty()


def test_the_language_sample_stays_bounded(spark, monkeypatch):
    rng = random.Random(3)
    text = {"en": lambda: " ".join(rng.choice(["the", "house", "of", "this", "other"]) for _ in range(12)),
            "de": lambda: " ".join(rng.choice(["der", "über", "nicht", "haus", "größe"]) for _ in range(12))}
    rows = [(1, text["en"](), "en") for _ in range(300)] + [(1, "der gleiche text über nichts", "de")] * 2000
    rows += [(k, text[lang](), lang) for k in range(2, 302) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    learn = language.follow_the_leader
    monkeypatch.setattr(language, "follow_the_leader", lambda rows, *a, **k: (seen.append(len(rows)), learn(rows, *a, **k))[1])
    model = language.fit(docs, most=600)
    assert seen[0] <= 600
    got = {r.lang_pred for r in language.predict(docs.where("lang = 'de'"), model).collect()}
    assert got == {"de"}
