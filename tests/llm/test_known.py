"""What is known of a language: counted over all of its training rows, not over the sample that the weights come from."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from mailspark.llm import language

SIZE = 1 << 12


def test_known_n_grams_come_from_all_training_rows(spark):
    rng = random.Random(4)
    words = {"aa": ["bado", "gipe", "lumo", "nira"], "bb": ["torv", "shenk", "wulf", "krimp"]}
    rare = {"aa": "zxzx", "bb": "qyqy"}  # in one row of 25
    rows = []
    for k in range(1200):
        lang = sorted(words)[k % 2]
        rows.append((k, " ".join([*rng.choices(words[lang], k=8), *[rare[lang]] * (k % 50 < 2)]), lang))
    rows += rows[:100]  # rows that repeat count as often as they are there
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, most=20, dimensions=SIZE)

    drawn = sorted(language.sample(docs, 24).collect(), key=lambda r: (r.place, r.lang, r.row))
    apart, seen = set(), set()
    for k, r in enumerate(drawn):
        if k % 5 == 0 and r.lang in seen:
            apart.add(r.doc_id)
        seen.add(r.lang)
    assert len(drawn) == 24 and apart
    count, n = np.zeros((SIZE, 2), int), np.zeros(2, int)
    for k, text, lang in rows:
        if k not in apart:
            n["ab".index(lang[0])] += 1
            for _, _, _, feature, _ in language.term_counts(pa.array([text]), dimensions=SIZE):
                count[feature, "ab".index(lang[0])] += 1
    assert (model.known == (count >= np.maximum(1, language.KNOWN * n))).all()
    for name, text in rare.items():
        _, _, _, feature, _ = next(language.term_counts(pa.array([text]), dimensions=SIZE))
        assert model.known[feature, "ab".index(name[0])].all()
