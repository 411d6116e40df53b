"""Hard negatives against a plain search over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from mailspark.llm import mining

TABLE = "vec_id long, label int, embedding array<float>, q string, tile int, x string"


def plain(rows, anchors, positives=5, negatives=5, share=80):
    seen: dict = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        q = [math.floor(256 * float(np.float32(c))) for c in v]
        seen[i] = min(seen.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in seen.items():
        if not anchors(a):
            continue
        scores = sorted((-dot(q, p), i, of) for i, (of, p) in seen.items() if i != a)
        for s, i, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [x for x in scores if x[2] != label and share * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, i, k, n, -s, -m) for k, (m, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, condition, **sizes):
    table = spark.createDataFrame([(*r, "q", 1, "x") for r in rows], TABLE).repartition(3)
    found = mining.hard_negatives(mining.vectors(table), condition, **sizes)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def awkward(seed: int, n: int, dims: int, labels: int = 4) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(int(k), int(rng.integers(labels)), [float(np.float32(c)) for c in centres[rng.integers(6)] + rng.normal(size=dims) * 0.2])
            for k in range(n)]
    hot = [0.5] * dims
    rows = [(i, label, hot if i % 3 == 0 else v) for i, label, v in rows]  # a third is one vector: many equal scores
    return rows + [(n, None, hot), (n + 1, 1, None), (n + 2, 1, [None] * dims), (n + 3, 1, [float("nan")] * dims), (None, 1, hot),
                   (n + 4, 2, [float("inf")] * dims), (n + 5, 3, [0.0] * dims), (n + 6, 0, []), (n + 7, 1, hot[:1]),
                   rows[10], rows[10], (10, 0, hot), (-20, 1, hot)]


@pytest.mark.parametrize("sizes", [{}, {"part": 16, "leaf": 3, "boxes": 40}, {"part": 40, "leaf": 8, "sample": 30}])
def test_equals_all_pairs(spark, sizes):
    rows = awkward(1, 300, 5)
    assert mined(spark, rows, "vec_id % 10 = 0", **sizes) == plain(rows, lambda i: i % 10 == 0)


def test_whole_numbers_stay_exact(spark):
    """Products past 2 ** 53 are computed in whole numbers; past 64 bits they are refused."""
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, [float(np.float32(c)) for c in rng.normal(size=4) * 3e4]) for k in range(60)]
    want = plain(rows, lambda i: i % 6 == 0, share=1)
    table = spark.createDataFrame([(*r, "q", 1, "x") for r in rows], TABLE)
    found = mining.hard_negatives(mining.vectors(table), "vec_id % 6 = 0", share=1, part=10, leaf=4)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                  for r in found.collect()) == want
    assert mining.index(mining.vectors(table)).tiles.exact is np.float64
    large = mining.vectors(spark.createDataFrame([(1, 1, [5e5, 5e5, 5e5], "", 1, "")], TABLE))
    assert mining.index(large).tiles.exact is np.int64
    with pytest.raises(ValueError, match="64 bits"):
        mining.index(mining.vectors(spark.createDataFrame([(1, 1, [1e10], "", 1, "")], TABLE)))


def test_few_rows(spark):
    assert mined(spark, [], "true") == [] and mined(spark, [(1, 1, [1.0])], "true") == []
    assert mined(spark, [(1, None, [1.0]), (2, 1, None)], "true") == []
    rows = [(1, 1, [1.0, 0.5]), (2, 1, [1.0, 0.25]), (3, 2, [0.9, 0.5]), (4, 2, [-1.0, 0.0])]
    assert mined(spark, rows, "true") == plain(rows, lambda i: True)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-9, 9, (40, 3)), rng.integers(-9, 9, (7, 3))
    least, most = mining.intervals(q, x.min(axis=0)[None], x.max(axis=0)[None])
    product = q @ x.T
    assert (least[:, 0] <= product.min(axis=1)).all() and (most[:, 0] >= product.max(axis=1)).all()


def test_tree_holds_every_row_once(spark):
    rows = awkward(3, 200, 3)
    table = mining.vectors(spark.createDataFrame([(*r, "q", 1, "x") for r in rows], TABLE))
    tree = mining.index(table, part=20, leaf=6)
    held = [r for r in tree.entries.select("tile", "part", "leaf", "id").collect()]
    assert sorted(r.id for r in held) == sorted(r.vec_id for r in table.collect()) and len(tree.tiles.number) > 3
    sizes: dict = {}
    for r in held:
        sizes[r.tile, r.part, r.leaf] = sizes.get((r.tile, r.part, r.leaf), 0) + 1
    assert max(sizes.values()) <= 6
    runs = mining.slices(np.array([[k % 7, k // 7] for k in range(49)]), 9, [0, 1])
    assert sorted(np.concatenate(runs).tolist()) == list(range(49)) and {len(r) for r in runs} <= {4, 5, 6}
