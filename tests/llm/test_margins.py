"""Naive Bayes support vectors against plain restatements."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from mailspark.llm import margins
from tests.llm import samples

DOCS = "doc_id long, text string, score string, good string, place string, _id string"


def shape(word: bytes, before: bytes | None) -> tuple:
    out = []
    for c in word:
        kind = 97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out), word == before


def grams(text: str | None) -> set:
    """Distinct n-grams: words 1 and 2, shapes 1 to 3, or the mark of a text without words."""
    w = (text or "").encode().split()
    s = [shape(x, w[k - 1] if k else None) for k, x in enumerate(w)]
    found = {("w", tuple(w[k:k + n])) for n in (1, 2) for k in range(len(w) - n + 1)}
    return found | {("s", tuple(s[k:k + n])) for n in (1, 2, 3) for k in range(len(s) - n + 1)} or {"none"}


def test_indicators_are_the_distinct_grams():
    texts = ["a b a b", "B!! b?? B!!", None, "", "  ", "x x x x", "Ab1 AB2 ab-3 é ß\tq", "one " * 900, "w1 w2 w3"]
    seen = {}
    for first, rows, row, feature in margins.indicators(pa.array(texts), 1 << 40):
        for r in range(rows):
            seen[first + r] = set(feature[row == r].tolist())
    assert [len(seen[k]) for k in range(len(texts))] == [len(grams(t)) for t in texts]
    for k, t in enumerate(texts):  # equal grams, equal features
        for j, u in enumerate(texts):
            assert len(seen[k] & seen[j]) == len(grams(t) & grams(u))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x, truth = rng.normal(size=(80, 6)), rng.normal(size=6)
    y = np.where(x @ truth + 0.3 + rng.normal(size=80) * 0.5 > 0, 1.0, -1.0)
    w = margins.dual_coordinate_descent([(np.arange(6), r) for r in x], y, 6, cost=0.7, epochs=2000, tolerance=1e-6)
    with_bias = np.column_stack([x, np.ones(80)])
    loss = lambda w: w @ w / 2 + 0.7 * np.maximum(0, 1 - y * (with_bias @ w)).sum()
    plain, best = np.zeros(7), math.inf
    for step in range(1, 20_000):  # subgradient steps
        short = y * (with_bias @ plain) < 1
        plain = plain - (plain - 0.7 * (y[short, None] * with_bias[short]).sum(axis=0)) / step
        best = min(best, loss(plain))
    assert loss(w) <= best + 1e-3
    assert (margins.dual_coordinate_descent([], np.zeros(0), 3) == 0).all()


def test_log_ratios_and_calibration():
    counts = np.array([[3, 1], [0, 0], [2, 2]])
    good, bad = (counts[:, 1] + 1) / 6, (counts[:, 0] + 1) / 8
    assert np.allclose(margins.log_ratios(counts), [math.log(good[0] / bad[0]), 0, math.log(good[2] / bad[2])])
    rng = np.random.default_rng(3)
    m = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(float)
    slope, offset = margins.calibrate(m, y, np.ones(4000))
    assert abs(slope - 2) < 0.2 and abs(offset + 0.5) < 0.15
    assert all(map(math.isfinite, margins.calibrate(np.array([1.0, 2.0]), np.ones(2), np.ones(2))))


def corpus(n: int = 400) -> tuple[list, list]:
    rng = random.Random(4)
    good = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = " ".join(rng.choice(good) for _ in range(rng.choice([3, 20, 80])))
        if bad := rng.random() < 0.3:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "&&& "), " ".join([good[k]] * 12)])
        rows.append((k, text, "s", "g", "p", "i"))
        if k % 4:
            labels.append((k, not bad))
    rows += [(n, None, *"abcd"), (n + 1, "", *"abcd"), (None, "good", *"abcd"), rows[0], rows[0], (n + 2, "long " * 60_000, *"abcd")]
    labels += [(None, True), (n + 7, None), (n + 1, False), (5, False), (5, True)]
    return rows, labels


@pytest.fixture(scope="module")
def given(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, DOCS).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, good boolean").cache()


def test_class_counts_cover_all_labelled_rows(spark, given):
    docs, labels = given
    rows, marks = corpus()
    least: dict = {}
    for i, g in marks:
        if i is not None and g is not None:
            least[i] = min(least.get(i, True), g)
    want = {True: 0, False: 0}
    for r in rows:
        if r[0] in least:
            want[least[r[0]]] += len(grams(r[1]))
    for travel in (0, 1 << 20):
        counts, n = margins.class_counts(margins.labelled(docs, labels, travel), 1 << 20)
        gone = np.array([want[False], want[True]]) - counts.sum(axis=0)  # hashed n-grams of one text that meet
        assert (gone >= 0).all() and (gone <= 5).all()
        assert n.tolist() == [sum(least.get(r[0]) is g for r in rows) for g in (False, True)]


def test_model_equals_a_plain_one(spark, given):
    """Same log-ratios, vectors, multipliers and curve from plain sets of n-grams."""
    docs, labels = given
    model = margins.fit(docs, labels, most=10_000)
    table = margins.labelled(docs, labels).orderBy("place", "good").toPandas()
    index: dict = {}
    numbered = [np.array(sorted(index.setdefault(g, len(index)) for g in grams(t))) for t in table.text]
    counts = np.zeros((len(index), 2), int)
    for f, g in zip(numbered, table.good):
        counts[f, int(g)] += 1
    used = (model.ratio != 0).sum()
    ratio = np.log((counts[:, 1] + 1) / (counts[:, 1].sum() + margins.DIMENSIONS) * (counts[:, 0].sum() + margins.DIMENSIONS) / (counts[:, 0] + 1))
    assert abs(used - len(index)) <= 0.75 * len(index) ** 2 / margins.DIMENSIONS  # hashed features that meet
    rows = [(f, ratio[f] / max(1e-12, np.linalg.norm(ratio[f]))) for f in numbered]
    back = np.arange(len(rows)) % 5 == 0
    sign = np.where(table.good, 1.0, -1.0)
    train = np.flatnonzero(~back)
    w = margins.dual_coordinate_descent([rows[k] for k in train], sign[train], len(index))
    margin = np.array([v @ w[f] + w[-1] for f, v in rows])
    mine = margins.score(docs, model).toPandas()
    by_id = mine.dropna().groupby("doc_id").score.first()
    weight = np.array([(~table.good).sum() / (~table.good[back]).sum(), table.good.sum() / table.good[back].sum()])
    slope, offset = margins.calibrate(margin[back], table.good[back].to_numpy(float), weight[table.good[back].astype(int)])
    plain = margins.sigmoid(slope * margin + offset)
    ids = {t: i for i, t, *_ in corpus()[0] if i is not None}
    apart = [abs(plain[k] - by_id[ids[t]]) for k, t in enumerate(table.text) if t]

    assert np.mean(apart) < 0.03 and np.quantile(apart, 0.9) < 0.1


def test_scores_of_awkward_rows(spark, given):
    docs, labels = given
    rows, marks = corpus()
    model = margins.fit(docs, labels)
    got = margins.score(docs, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    n = len(rows) - 6
    by_id = got.dropna().groupby("doc_id").score.agg(["min", "max", "size"])
    assert by_id.loc[n, "max"] == by_id.loc[n + 1, "max"]  # null and empty
    assert by_id.loc[0, "size"] == 3 and by_id.loc[0, "min"] == by_id.loc[0, "max"]
    held = [k for k in range(n) if k % 4 == 0]
    bad = {k: any(s in rows[k][1] for s in ("!!", "&&&")) or len(set(rows[k][1].split())) == 1 for k in held}
    assert np.mean([(by_id.loc[k, "max"] >= 0.5) != bad[k] for k in held]) > 0.95
    # many rows of one id do not pass the bound of the sample
    same = spark.createDataFrame([(3, f"word{k}") for k in range(500)], "doc_id long, text string")
    assert margins.fit(same, labels, most=20) is not None


def test_scores_without_rows_or_labels(spark, given):
    docs, labels = given
    assert margins.fit(docs, labels.where("false")) is None and margins.fit(docs.where("false"), labels) is None
    assert {r.score for r in margins.score(docs, None).collect()} == {0.5}
    assert margins.score(docs.where("false"), None).isEmpty()
    one = margins.fit(docs, labels.where("good"))
    assert all(0 <= r.score <= 1 for r in margins.score(docs, one).collect())


def test_query_holds_out_a_fifth(spark):
    folder = "/root/testdata/sf0.01"
    got = margins.op11_quality_scores(spark, folder).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (samples.crc(i) % 5 == 0) for i in got.index)
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    truth = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id").quality
    held = [i for i in truth.index if got.held_out[i]]
    assert np.mean([got.predicted[i] == truth[i] for i in held]) > 0.97
