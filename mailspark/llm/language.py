"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, elastic net), then calibrated by one temperature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.llm.tables import crc_of_id, read, stored
from mailspark.llm.words import chunks, mixed

#: Hashed features.
DIMENSIONS = 1 << 15
LONGEST = 3
#: Labelled rows that the weights and the temperature are fitted on, at most; with many languages EACH for every one.
LABELLED = 3_000
EACH = 12
UNKNOWN = "und"
#: An n-gram is known to a language if this share of its training rows (and one row at least) has it.
KNOWN = 0.01
#: Languages whose counts a task holds at once.
HELD = 64
#: Held-back labelled rows that each of the two tests of readable() may reject, as a share of them.
LOSS = 0.005
#: Limits lie this much below the row that sets them, as vectors reach the driver as 32-bit numbers.
SLACK = 1e-5
HAS_LETTER, PREDICTED, SCORE, FAMILIAR = "_has_letter", "_lang_pred", "_score", "_familiar"
LETTER = r"\p{L}"
#: Bytes of text that are counted at a time: what is made of them stays in a core's cache.
CHUNK = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.arange(256) < 0xAA
_BLANK[[*range(65, 91), *range(97, 123)]] = False
_GRAM = np.uint64(0x2545F4914F6CDD1D)
_ORDER = [("place", "ascending"), ("lang", "ascending"), ("row", "ascending")]


def _code_points(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, case folded where one byte pair holds the letter, and the texts' positions."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    byte = data[start]
    out = _LOWER[byte].astype(np.uint32)
    many = np.flatnonzero(byte >= 0x80)  # only these have more bytes to read
    first, start_ = byte[many].astype(np.uint32), start[many]
    tail = lambda k: np.where(start_ + k < len(data), data[np.minimum(start_ + k, len(data) - 1)], 0).astype(np.uint32) & 0x3F
    point = np.where(first < 0xE0, (first & 0x1F) << 6 | tail(1), np.where(
        first < 0xF0, (first & 0x0F) << 12 | tail(1) << 6 | tail(2), (first & 7) << 18 | tail(1) << 12 | tail(2) << 6 | tail(3)))
    upper = ((point >= 65) & (point <= 90)) | ((point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)) | (
        (point >= 0x391) & (point <= 0x3A9)) | ((point >= 0x410) & (point <= 0x42F))
    out[many] = np.where(upper, point + 32, point)
    return out, np.searchsorted(start, text_at)


def term_counts(texts: pa.Array, longest: int = LONGEST, dimensions: int = DIMENSIONS
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts: first row, rows, and the row, feature and count of every n-gram feature of its texts.

    White space runs count as one blank, at a text's start as well; digits and ASCII signs as nothing but a break.
    """
    for chunk in chunks(texts, keys=False, size=CHUNK):
        point, at = _code_points(chunk.data, chunk.text_at)
        row = np.repeat(np.arange(chunk.rows), np.diff(at)).astype(np.uint64)
        blank = _BLANK[np.minimum(point, 0xFF)]
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[at[:-1][np.diff(at) > 0]] = True  # whatever the text before ends with
        point, row = np.where(blank, 32, point)[keep].astype(np.uint64), row[keep]
        found, base = [], row * np.uint64(dimensions)
        with np.errstate(over="ignore"):
            code = np.zeros(len(point), np.uint64)
            for n in range(1, longest + 1):
                if len(point) < n:
                    break
                code = code[:len(point) - n + 1] * _GRAM + point[n - 1:] + np.uint64(1)
                inside = row[n - 1:] == row[:len(row) - n + 1]
                feature = mixed(code ^ np.uint64(n << 56)) & np.uint64(dimensions - 1)
                found.append((base[:len(row) - n + 1] + feature)[inside])
        cells = np.concatenate(found) if found else np.zeros(0, np.uint64)
        cells, counts = _counted(cells, chunk.rows * dimensions)
        yield chunk.first, chunk.rows, (cells // dimensions).astype(np.int64), (cells % dimensions).astype(np.int64), counts


def _counted(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size <= 16 * len(cells):
        counts = np.bincount(cells.astype(np.int64), minlength=size)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(cells.astype(np.int64), return_counts=True)


def frequencies(docs: DataFrame, apart: np.ndarray, longest: int = LONGEST, dimensions: int = DIMENSIONS) -> DataFrame:
    """lang, feature, n: in how many texts of a language each feature occurs, over all rows of ``docs`` (key, text, lang).

    The feature ``dimensions`` counts the rows. Rows whose key is one of ``apart`` count under a null language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def given() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            coded = batch["lang"].dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            number = np.where(np.isin(batch["key"].to_numpy(), apart), len(names) - 1, coded.indices.to_numpy())
            for first, rows, row, feature, _ in term_counts(batch["text"], longest, dimensions):
                of = number[first:first + rows]
                cells, counts = _counted(of[row] * dimensions + feature, len(names) * dimensions)
                texts, edge = np.bincount(of, minlength=len(names)), np.searchsorted(cells, np.arange(len(names) + 1) * dimensions)
                for k in np.flatnonzero(texts):
                    n = held.setdefault(names[k], np.zeros(dimensions + 1, np.int64))
                    n[cells[edge[k]:edge[k + 1]] - k * dimensions] += counts[edge[k]:edge[k + 1]]
                    n[-1] += texts[k]
                if len(held) > HELD:
                    yield from given()
        yield from given()

    rows = docs.select("key", "text", "lang").mapInArrow(run, "lang string, feature long, n long")
    return rows.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def document_frequencies(counts: DataFrame, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and the number of texts; ``counts`` as frequencies() gives them."""
    rows = counts.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(dimensions + 1, np.int64)
    out[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def _weighed(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF values, (1 + log count) * idf, each text's vector of length 1."""
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / np.maximum(norm, 1e-12)[row]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray      # features (and one row for the bias) x languages; most are 0
    temperature: float
    known: np.ndarray        # features x languages: whether the language's training rows have the n-gram
    least_score: float = 0.0
    least_known: float = 0.0

    def familiar(self, row: np.ndarray, feature: np.ndarray, language: np.ndarray, rows: int) -> np.ndarray:
        """The share of each text's distinct n-grams that are known to the language given for it."""
        return np.bincount(row, self.known[feature, language[row]], rows) / np.maximum(np.bincount(row, minlength=rows), 1)

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        out = np.tile(self.weights[-1], (rows, 1))
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(row, value * self.weights[feature, k], rows)
        return out / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int, classes: int, epochs: int = 5,
                      alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights after ``epochs`` passes over (features, values, class).

    Each coordinate keeps the sum z of its gradients, less what its moves so far made of them, and the sum n of their
    squares. Its weight is the minimiser of the sum of linearised losses plus l1 * |w| + l2 * w**2 / 2: 0 while
    |z| <= l1, so that features that do not matter stay out.
    """
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for features, values, label in rows:
            at, x = np.append(features, dimensions), np.append(values, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = np.outer(x, error)
            squares = n[at] + gradient ** 2
            z[at] += gradient - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    return weights(slice(None))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes held-back labels most likely, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, golden = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def limit(values: np.ndarray, loss: float = LOSS) -> float:
    """The value that at most ``loss`` of ``values`` lie below; 0 without any."""
    return float(np.sort(values)[int(loss * len(values))]) - SLACK if len(values) else 0.0


def known_features(counts: DataFrame, languages: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """features x languages: whether enough of all training rows of the language have the n-gram. ``counts`` as
    frequencies() gives them; only what is known comes to the driver."""
    counts = counts.where("lang IS NOT NULL")
    rows = counts.where(F.col("feature") == dimensions).select("lang", F.col("n").alias("rows"))
    found = counts.where(F.col("feature") < dimensions).join(F.broadcast(rows), "lang").where(
        F.col("n") >= F.greatest(F.lit(1.0), KNOWN * F.col("rows"))).select("lang", "feature").toArrow()
    known = np.zeros((dimensions, len(languages)), bool)
    if len(found):
        coded = found["lang"].combine_chunks().dictionary_encode()
        at = np.array([languages.index(name) for name in coded.dictionary.to_pylist()])
        known[found["feature"].to_numpy(), at[coded.indices.to_numpy()]] = True
    return known


def sample(docs: DataFrame, most: int = LABELLED) -> DataFrame:
    """row, doc_id, lang, place of at most ``most`` labelled rows of ``docs`` (doc_id, text, lang), or EACH for every
    language if that is more, in equal shares as far as they go; equal rows count once.

    A row's place is its random number times the number of rows of its language, so the smallest places hold the
    languages in equal shares; no language meets in one task. The row of the smallest place of each language is taken
    before all others, so that every language is learned.
    """
    docs = stored(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "lang").distinct(), "labelled")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = (F.xxhash64("doc_id", F.lit("draw")) % 1_000_000_007 + 1_000_000_007) * F.col("_n")
    thin = docs.join(counts, "lang").select("row", "doc_id", "lang", draw.alias("place"))
    firsts = thin.groupBy("lang").agg(F.min(F.struct("place", "doc_id", "row")).alias("_first"))
    first = F.struct("place", "doc_id", "row") == F.col("_first")
    ranked = thin.join(firsts, "lang").select("row", "doc_id", "lang", "place", first.alias("_is_first"))
    most = max(most, EACH * counts.count())
    return ranked.orderBy(F.desc("_is_first"), "place", "doc_id", "row").limit(most).drop("_is_first")


def _held_back(drawn: pa.Table) -> np.ndarray:
    """Which of the sampled rows, by place, are held back from training: every fifth, but no language's first row."""
    seen, out = set(), []
    for k, name in enumerate(drawn["lang"].to_pylist()):
        out.append(k % 5 == 0 and name in seen)
        seen.add(name)
    return np.array(out, bool)


def fit(docs: DataFrame, most: int = LABELLED, longest: int = LONGEST, dimensions: int = DIMENSIONS) -> Model | None:
    """A model of the labelled rows of ``docs`` (doc_id, text, lang); None without any.

    Document frequencies count all of these rows, and so does what is known of a language, but for the rows held back.
    The weights are fitted on a sample(), whose feature vectors (at most ``dimensions`` entries each) come to the
    driver; one in five of them is held back and sets the temperature and the limits below which a text is in no
    language: each rejects LOSS of these rows at most. Null texts, labels and ids take no part. Every label is learned.
    Rows that repeat an id are rows of their own; equal rows are sampled once, so no more than the sample comes to the
    driver.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    chosen = stored(sample(docs, most), "sample")
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    key = F.xxhash64("row", "lang").alias("key")
    drawn = chosen.select("place", "lang", "row", key).toArrow().sort_by(_ORDER)
    apart = drawn["key"].to_numpy()[_held_back(drawn)]
    counts = stored(frequencies(docs.select(key, "text", "lang"), apart, longest, dimensions), "frequencies")
    held, n = document_frequencies(counts, dimensions)
    idf = np.log((1 + n) / (1 + held)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, feature, count in term_counts(batch["text"], longest, dimensions):
                at = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                value = _weighed(row, feature, count, idf, rows).astype(np.float32)
                yield pa.record_batch([
                    *(batch[c].slice(first, rows) for c in ("row", "place", "lang", "key")),
                    pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(value))], names=["row", "place", "lang", "key", "features", "values"])

    picked = docs.join(F.broadcast(chosen.select("row", "lang", "place")), ["row", "lang"]).select("row", "place", "lang", key, "text")
    vectors = picked.mapInArrow(run, "row long, place long, lang string, key long, features array<int>, values array<float>")
    vectors = vectors.dropDuplicates(["row", "lang"])  # rows that repeat in the table
    table = vectors.toArrow().sort_by(_ORDER)
    if not len(table):
        return None
    languages = sorted(set(table["lang"].to_pylist()))
    label = {name: k for k, name in enumerate(languages)}
    rows = [(f.values.to_numpy(), v.values.to_numpy().astype(float), label[name.as_py()])
            for f, v, name in zip(table["features"], table["values"], table["lang"])]
    back = np.isin(table["key"].to_numpy(), apart)
    train, kept = [r for r, b in zip(rows, back) if not b], [r for r, b in zip(rows, back) if b]
    weights = follow_the_leader(train, dimensions, len(languages))
    logits = np.array([v @ weights[f] + weights[-1] for f, v, _ in kept]).reshape(-1, len(languages))
    model = Model(languages, idf, weights, calibrate(logits, np.array([c for _, _, c in kept], int)),
                  known_features(counts, languages, dimensions))
    lettered = [k for k, (f, _, _) in enumerate(kept) if len(f)]
    p = softmax(logits[lettered] / model.temperature)
    shares = [model.known[kept[k][0], c].mean() for k, c in zip(lettered, p.argmax(axis=1))]
    model.least_score, model.least_known = limit(p.max(axis=1)), limit(np.array(shares))
    return model


def _predictions(docs: DataFrame, kept: list[str], model: Model | None, longest: int, dimensions: int) -> DataFrame:
    """The ``kept`` columns of ``docs``, with the language of its text and a score; ``docs`` has HAS_LETTER as well."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, shares = [], [], []
            for _, rows, row, feature, count in term_counts(batch["text"], longest, dimensions):
                if model is None:
                    names += [UNKNOWN] * rows
                    scores.append(np.zeros(rows))
                    shares.append(np.zeros(rows))
                    continue
                p = softmax(model.logits(row, feature, _weighed(row, feature, count, model.idf, rows), rows))
                best = p.argmax(axis=1)
                names += [model.languages[k] for k in best]
                scores.append(p.max(axis=1))
                shares.append(model.familiar(row, feature, best, rows))
            readable = batch[HAS_LETTER]
            name = pc.if_else(readable, pa.array(names, pa.string()), UNKNOWN)
            score = pc.if_else(readable, pa.array(np.concatenate(scores) if scores else np.zeros(0)), 0.0)
            share = pa.array(np.concatenate(shares) if shares else np.zeros(0))
            yield pa.record_batch([*(batch[c] for c in kept), name, score, share], names=[*kept, PREDICTED, SCORE, FAMILIAR])

    schema = docs.select(*kept).schema.add(PREDICTED, "string").add(SCORE, "double").add(FAMILIAR, "double")
    return docs.mapInArrow(run, schema)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(HAS_LETTER, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))


def predict(docs: DataFrame, model: Model | None, longest: int = LONGEST, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text); the whole text counts.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text without a model. score is the
    calibrated probability of the language. Rows that repeat a doc_id are rows of their own.
    """
    rows = _marked(docs.select(F.col("doc_id").cast("long"), "text"))
    return _predictions(rows, ["doc_id"], model, longest, dimensions).select(
        "doc_id", F.col(PREDICTED).alias("lang_pred"), F.col(SCORE).alias("score"))


def readable(docs: DataFrame, model: Model | None, least: float | None = None, longest: int = LONGEST,
             dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs`` in some language, with their columns: those whose score is ``least`` or more and whose
    share of n-grams known to their language is high enough. Limits that are not given are the model's, which clean
    rows held back from its training set. Without a model all texts with a letter stay. Columns may have any names but
    the four with a leading underscore added here."""
    rows = _marked(docs).where(HAS_LETTER)
    if model is not None:
        rows = _predictions(rows, docs.columns, model, longest, dimensions).where(
            (F.col(SCORE) >= (model.least_score if least is None else least)) & (F.col(FAMILIAR) >= model.least_known))
    return rows.select(*docs.columns)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from four fifths of them."""
    docs = read(spark, folder, "documents")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
