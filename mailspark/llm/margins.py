"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-ratio of their counts in the two classes; a linear model with hinge loss is
fitted on the scaled vectors by dual coordinate descent. N-grams are of words (1 and 2) and of word shapes (1 to 3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.llm.tables import crc_of_id, read, stored
from mailspark.llm.words import Chunk, chunks, lists, mixed, span_keys, window_keys

#: Hashed indicators.
DIMENSIONS = 1 << 18
#: Labelled rows of each class that the hinge-loss model and its calibration are fitted on, at most.
LABELLED = 4_000
#: Labels that are sent to the tasks which read texts; more of them meet the texts in a shuffle.
TRAVEL = 1 << 20
#: A score from which a text counts as good.
LEAST_SCORE = 0.3
_SAME = np.uint64(0x6A09E667F3BCC909)
_NO_WORDS = np.uint64(0xBB67AE8584CAA73B)
#: What is left of a byte in a word's shape: one class for each kind of letter and for digits, other signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[128:], _SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48


def shape_keys(chunk: Chunk) -> np.ndarray:
    """A key of each word's shape: its classes of bytes without repeats, and whether it equals the word before it."""
    kinds = _SHAPE[chunk.data]
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[chunk.start] = True
    at = np.concatenate([[0], np.cumsum(first)])
    keys = span_keys(kinds[first], at[chunk.start], at[chunk.end])
    same = np.zeros(len(keys), bool)
    same[1:] = chunk.key[1:] == chunk.key[:-1]
    same[chunk.word_at[:-1][chunk.counts() > 0]] = False
    return np.where(same, keys ^ _SAME, keys)


def indicators(texts: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: first row, rows, and the row and feature of every distinct n-gram of each text.

    A text without words has one feature of its own.
    """
    for chunk in chunks(texts):
        row, cells = chunk.row_of_word().astype(np.uint64), []
        for keys, kind, longest in ((chunk.key, 1, 2), (shape_keys(chunk), 2, 3)):
            for n in range(1, longest + 1):
                at = chunk.window_starts(n)
                if len(at):
                    feature = mixed(window_keys(keys, n)[at] ^ np.uint64(kind)) & np.uint64(dimensions - 1)
                    cells.append(row[at] * np.uint64(dimensions) + feature)
        empty = np.flatnonzero(chunk.counts() == 0).astype(np.uint64)
        cells.append(empty * np.uint64(dimensions) + (_NO_WORDS & np.uint64(dimensions - 1)))
        found = np.unique(np.concatenate(cells)).astype(np.int64)
        yield chunk.first, chunk.rows, found // dimensions, found % dimensions


def class_counts(rows: DataFrame, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of each class every feature occurs (features x 2), and the number of texts, over all ``rows``
    (text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * (dimensions + 1), np.int64)
        for batch in batches:
            good = batch["good"].to_numpy(zero_copy_only=False).astype(np.int64)
            held[-2:] += np.bincount(good, minlength=2)
            for first, _, row, feature in indicators(batch["text"], dimensions):
                held += np.bincount(2 * feature + good[first + row], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], names=["cell", "n"])

    table = rows.select("text", "good").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(2 * (dimensions + 1), np.int64)
    held[table["cell"].to_numpy()] = table["n"].to_numpy()
    return held[:-2].reshape(-1, 2), held[-2:]


def log_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (a feature's share of the good class's counts / its share of the other's); 0 for features without a text."""
    share = (counts + smoothing) / (counts + smoothing).sum(axis=0)
    return np.where(counts.sum(axis=1) > 0, np.log(share[:, 1] / share[:, 0]), 0.0)


def scaled(row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, rows: int) -> np.ndarray:
    """The value of each indicator: its log-ratio, each text's vector of length 1."""
    value = ratio[feature]
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / np.maximum(norm, 1e-12)[row]


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, dimensions: int,
                            cost: float = 1.0, epochs: int = 30, tolerance: float = 0.01, seed: int = 11) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + cost * the sum of hinge losses of ``rows``.

    One multiplier a row, between 0 and ``cost``. Each step sets one of them to its best value with all others fixed;
    w is kept as the sum of the rows times their multipliers. It ends when no projected gradient of a pass is far from
    0. Without rows all weights are 0.
    """
    w, multiplier = np.zeros(dimensions + 1), np.zeros(len(rows))
    squares = [float(values @ values) + 1.0 for _, values in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for k in order.permutation(len(rows)):
            features, values = rows[k]
            gradient = signs[k] * (values @ w[features] + w[-1]) - 1.0
            old = multiplier[k]
            if (old <= 0 and gradient >= 0) or (old >= cost and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            multiplier[k] = min(max(old - gradient / squares[k], 0.0), cost)
            step = (multiplier[k] - old) * signs[k]
            w[features] += step * values
            w[-1] += step
        if worst < tolerance:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def calibrate(margins: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to weighted shares of good rows (Newton steps, damped).

    A slight pull to slope 1 keeps the curve finite where the margins part the classes, or one class is missing.
    """
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], axis=1)
    pull = 1e-3 * max(1.0, weight.sum())

    def loss(theta):
        z = x @ theta
        return (weight * (np.logaddexp(0, z) - good * z)).sum() + pull / 2 * ((theta - [1.0, 0.0]) ** 2).sum()

    for _ in range(rounds):
        p = sigmoid(x @ theta)
        slope = x.T @ (weight * (p - good)) + pull * (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray    # log-ratio of each feature
    weights: np.ndarray  # one for each feature, and the bias
    slope: float
    offset: float

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        value = scaled(row, feature, self.ratio, rows)
        margin = np.bincount(row, value * self.weights[feature], rows) + self.weights[-1]
        return sigmoid(self.slope * margin + self.offset)


def labelled(docs: DataFrame, labels: DataFrame, travel: int = TRAVEL) -> DataFrame:
    """text, good, place of the rows of ``docs`` (doc_id, text) that have a label (doc_id, good).

    Null ids and null labels are left out; of several labels of one id the lowest counts. place is a hash of id and
    text, so rows that repeat an id have places of their own. Up to ``travel`` labels go to the texts.
    """
    known = labels.where("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    known = stored(known.select(F.col("doc_id").alias("_id"), "good"), "labels")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text"))
    known = F.broadcast(known) if known.count() <= travel else known
    return rows.join(known, "_id").select("text", "good", F.xxhash64("_id", "text").alias("place"))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, dimensions: int = DIMENSIONS, travel: int = TRAVEL,
        cost: float = 1.0) -> Model | None:
    """A model of the labelled rows of ``docs`` (doc_id, text); ``labels`` (doc_id, good boolean). None without any.

    Class counts are taken over all labelled rows. The hinge-loss model is fitted on up to ``most`` rows of each class,
    those of the smallest hashes, as vectors of ``dimensions`` entries at most; every fifth of them sets the
    calibration, in which each class weighs as much as all its labelled rows. Null texts are empty texts.
    """
    rows = labelled(docs, labels, travel)
    counts, n = class_counts(rows, dimensions)
    if not n.sum():
        return None
    ratio = log_ratios(counts)
    thin = rows.select("good", "place")
    cut = [thin.where(c).orderBy("place").limit(most).agg(F.max("place")).first()[0] for c in (~F.col("good"), F.col("good"))]
    chosen = F.lit(False)
    for good, place in zip((~F.col("good"), F.col("good")), cut):
        chosen = chosen if place is None else chosen | (good & (F.col("place") <= place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size, row, feature in indicators(batch["text"], dimensions):
                yield pa.record_batch([batch["good"].slice(first, size), batch["place"].slice(first, size),
                                       lists(feature.astype(np.int32), np.bincount(row, minlength=size))],
                                      names=["good", "place", "features"])

    vectors = stored(rows.where(chosen).mapInArrow(run, "good boolean, place long, features array<int>"), "vectors")
    parts = [vectors.where(c).orderBy("place").limit(most).toArrow() for c in (~F.col("good"), F.col("good"))]
    table = pa.concat_tables(parts).sort_by([("place", "ascending"), ("good", "ascending")])
    good = table["good"].to_numpy().astype(bool)
    vector = []
    for features in table["features"]:
        f = features.values.to_numpy()
        vector.append((f, scaled(np.zeros(len(f), np.int64), f, ratio, 1)))
    back = np.arange(len(vector)) % 5 == 0
    back &= len(vector) >= 10
    train = np.flatnonzero(~back)
    weights = dual_coordinate_descent([vector[k] for k in train], np.where(good[train], 1.0, -1.0), dimensions, cost)
    held = np.flatnonzero(back) if back.any() else train
    margins = np.array([v @ weights[f] + weights[-1] for f, v in (vector[k] for k in held)])
    share = np.bincount(good[held], minlength=2)
    slope, offset = calibrate(margins, good[held].astype(float), (n / np.maximum(share, 1))[good[held].astype(int)])
    return Model(ratio, weights, slope, offset)


def score(docs: DataFrame, model: Model | None, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text): how likely its text is good, from 0 to 1.

    Whole texts count; null texts are empty, and an empty text has the score of texts without words. Rows that repeat a
    doc_id, or have none, are rows of their own. Without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield pa.record_batch([batch["doc_id"], pa.array(np.full(len(batch), 0.5))], names=["doc_id", "score"])
                continue
            for first, rows, row, feature in indicators(batch["text"], dimensions):
                yield pa.record_batch([batch["doc_id"].slice(first, rows), pa.array(shared.value.scores(row, feature, rows))],
                                      names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def is_held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 0


def op11_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, learned from the quality labels of four fifths of them."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    model = fit(docs.where(~is_held_out(F.col("doc_id"))), labels.where(~is_held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
