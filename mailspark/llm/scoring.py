"""Language-model scores: prediction by partial matching over byte contexts, beside a smoothed word model.

The trie of contexts is a table. A node of depth d + 1 is a context of d bytes and the symbol behind it; its key holds
these bytes, the symbol in the lowest byte, so that a suffix of the context is a mask of the key. Escape estimation
and symbol exclusion run over these tables level by level, from no context up to the full order. What comes out is
one number for each full-order node, its log10 probability, and a text's score is the sum over its bytes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailspark.llm.tables import crc_of_id, read, stored
from mailspark.llm.words import Chunk, Lookup, chunks, signed

ORDER = 4
#: Bytes that UTF-8 never uses: what stands before a text, and the symbol that ends it.
PAD, END = 0xFE, 0xFF
SYMBOLS = 255
#: Keys of words have the sign bit, keys of nodes have not.
WORD_BIT = np.uint64(1 << 63)
END_WORD = WORD_BIT | np.uint64(1)
SMOOTHING = 0.1
#: The most frequent keys travel to every task, this many at most (16 bytes each); all others are joined.
FREQUENT = 1 << 20


@dataclass
class Model:
    """counts: key, n of every word and node. costs: key, n, v of every node. tokens, distinct: of the words."""

    counts: DataFrame
    costs: DataFrame
    tokens: int
    distinct: int

    @property
    def whole(self) -> float:
        return self.tokens + SMOOTHING * (self.distinct + 1)

    def values(self) -> DataFrame:
        """key, n, v: what one occurrence adds to the word score (key < 0) or to the model's score."""
        words = self.counts.where("key < 0").withColumn("v", F.log10((F.col("n") + SMOOTHING) / self.whole))
        return words.unionByName(self.costs)


def word_keys(chunk: Chunk) -> np.ndarray:
    return chunk.key | WORD_BIT


def nodes(chunk: Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes that a chunk's texts pass, text by text with its end, and rows + 1 positions of the texts."""
    sizes = np.diff(chunk.text_at)
    at = chunk.text_at + np.arange(chunk.rows + 1) * (order + 1)
    padded = np.full(at[-1], PAD, np.uint8)
    row = np.repeat(np.arange(chunk.rows), sizes)
    padded[np.arange(len(chunk.data)) + row * (order + 1) + order] = chunk.data
    padded[at[1:] - 1] = END
    keys = np.zeros(len(padded), np.uint64)
    for back in range(order, -1, -1):
        keys <<= np.uint64(8)
        keys[back:] |= padded[:len(padded) - back]
    return keys[padded != PAD], chunk.text_at + np.arange(chunk.rows + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Counter:
    """Sums by key with bounded memory; what it gives away is summed again behind the shuffle."""

    def __init__(self, soft: int = 1 << 20, hard: int = 1 << 21):
        self.parts, self.size, self.soft, self.hard = [], 0, soft, hard

    def add(self, keys: np.ndarray, weight: int) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * weight))
        self.size += len(keys)
        if self.size > self.soft:
            self.merge()
            if self.size > self.hard // 2:
                yield from self.flush()

    def merge(self) -> None:
        if self.parts:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, n in self.parts:
            for k in range(0, len(keys), 1 << 17):
                part = slice(k, k + (1 << 17))
                yield pa.record_batch([pa.array(signed(keys[part])), pa.array(n[part])], names=["key", "n"])
        self.parts, self.size = [], 0


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n over ``docs`` (text, train): words and text ends of training rows; nodes of all rows, with n from the
    training rows alone, so that a node seen elsewhere only has n = 0."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            train = batch["train"].to_numpy(zero_copy_only=False)
            for chunk in chunks(batch["text"], lower=True):
                learn = train[chunk.first:chunk.first + chunk.rows]
                keys, at = nodes(chunk, order)
                of_train = np.repeat(learn, np.diff(at))
                yield from counter.add(keys[of_train], 1)
                yield from counter.add(keys[~of_train], 0)
                yield from counter.add(word_keys(chunk)[np.repeat(learn, chunk.counts())], 1)
                yield from counter.add(np.full(int(learn.sum()), END_WORD), 1)
        yield from counter.flush()

    parts = docs.select("text", "train").mapInArrow(counted, "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def node_costs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n, v: the log10 probability of each full-order node (key >= 0), with escapes and exclusion.

    At depth j a context has n symbols, d of them distinct. Symbols of the context one byte longer are excluded, as
    coding only gets here when none of them came: n and d go down by theirs. A symbol that is there has the
    probability count / (n + d); the escape to the next shorter context has d / (n + d), or 1 where nothing is left.
    Behind the empty context all symbols not seen anywhere are equally likely. A context has at most 255 symbols, so
    the windows are small whatever the corpus.
    """
    low = lambda depth: F.col("key").bitwiseAND(F.lit((1 << (8 * depth)) - 1))
    everything = counts.where("key >= 0")
    level = None
    for j in range(order + 1):
        own = everything if j == order else everything.groupBy(low(j + 1).alias("key")).agg(F.sum("n").alias("n"))
        here = Window.partitionBy("ctx")
        seen = F.col("n") > 0
        if level is None:
            rows = own.withColumn("ctx", F.lit(0).cast("long"))
            rows = rows.withColumn("d", F.count(F.when(seen, 1)).over(here))
            rows = rows.withColumn("back", -F.log10(F.lit(float(SYMBOLS)) - F.col("d")))
        else:
            rows = own.withColumn("up", low(j)).join(level, "up").withColumn("ctx", F.shiftright("key", 8))
            rows = rows.withColumn("d", F.count(F.when(seen, 1)).over(here))
            left = F.col("up_all") - F.coalesce(F.sum(F.when(seen, F.col("up_n"))).over(here), F.lit(0))
            kinds = F.col("up_d") - F.col("d")
            escape = F.when(left > 0, F.log10(kinds / (left + kinds))).otherwise(F.lit(0.0))
            back = F.when(F.col("up_n") > 0, F.log10(F.col("up_n") / (left + kinds))).otherwise(escape + F.col("up_back"))
            rows = rows.withColumn("back", F.when(~seen, back))
        rows = rows.withColumn("all", F.sum("n").over(here))
        level = rows.select(F.col("key").alias("up"), F.col("n").alias("up_n"), F.col("all").alias("up_all"),
                            F.col("d").alias("up_d"), F.col("back").alias("up_back"))
    total = F.col("up_all") + F.col("up_d")
    escape = F.when(F.col("up_all") > 0, F.log10(F.col("up_d") / total)).otherwise(F.lit(0.0))
    value = F.when(F.col("up_n") > 0, F.log10(F.col("up_n") / total)).otherwise(escape + F.col("up_back"))
    return level.select(F.col("up").alias("key"), F.col("up_n").alias("n"), value.alias("v"))


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of the rows of ``docs`` (text, train boolean) with train; the others only name nodes to be priced.

    Null texts are empty. Without training rows every probability is that of the uniform model.
    """
    counts = stored(count(docs, order), "counts")
    costs = stored(node_costs(counts, order), "costs")
    words = counts.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return Model(counts, costs, words[0], words[1])


def _frequent(model: Model, most: int) -> tuple[Broadcast, float]:
    """The keys above a frequency such that they are ``most`` at most, and that frequency."""
    values = model.values()
    octave = F.floor(F.log2(F.col("n")) * 8)
    by_octave = values.where("n > 0").groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect()
    least, held = math.inf, 0
    for row in by_octave:
        held += row["count"]
        if held > most:
            break
        least = row["o"]
    hot = values.where((F.col("n") > 0) & (octave >= least)).select("key", "v").toArrow() if least < math.inf else None
    keys = hot["key"].to_numpy().view(np.uint64) if hot else np.zeros(0, np.uint64)
    v = hot["v"].to_numpy() if hot else np.zeros(0)
    return model.counts.sparkSession.sparkContext.broadcast((Lookup(np.ascontiguousarray(keys)), v)), least


def score(docs: DataFrame, model: Model, order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs`` (doc_id, text), whose texts ``fit`` was
    given, for training or not.

    The frequent keys are looked up where the text is read. Keys of a text that are not among them stay as a list
    beside its sums, and are priced by a join over the whole key table: no key is left out, whatever its number.
    Rows that repeat a doc_id are rows of their own. A null or empty text has one token, its end.
    """
    hot, least = _frequent(model, frequent)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = hot.value
        v = np.append(v, 0.0)  # position -1: not frequent
        uid = TaskContext.get().partitionId() << 40
        end_at = table.find(np.array([END_WORD]))
        for batch in batches:
            for chunk in chunks(batch["text"], lower=True):
                keys, at = nodes(chunk, order)
                found = table.find(keys)
                total = np.add.reduceat(v[found], at[:-1])
                words = word_keys(chunk)
                of_word = table.find(words)
                row = chunk.row_of_word()
                base = np.bincount(row, v[of_word], chunk.rows) + v[end_at]
                known = np.bincount(row, of_word >= 0, chunk.rows).astype(np.int64) + (end_at >= 0)
                ends = np.arange(chunk.rows) if end_at < 0 else np.zeros(0, np.int64)
                rest = np.concatenate([keys[found < 0], words[of_word < 0], np.full(len(ends), END_WORD)])
                owner = np.concatenate([np.repeat(np.arange(chunk.rows), np.diff(at))[found < 0], row[of_word < 0], ends])
                by_owner = np.argsort(owner, kind="stable")
                sizes = np.bincount(owner, minlength=chunk.rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.record_batch([
                    pa.array(uid + np.arange(chunk.rows)), batch["doc_id"].slice(chunk.first, chunk.rows),
                    pa.array(chunk.counts() + 1), pa.array(known), pa.array(base), pa.array(total),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(rest[by_owner])))],
                    names=["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])
                uid += chunk.rows

    schema = "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<long>"
    sums = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, schema), "scores")
    values = model.values()
    if least < math.inf:
        values = values.where((F.col("n") == 0) | (F.floor(F.log2(F.col("n")) * 8) < least))
    is_word = F.col("key") < 0
    late = sums.select("uid", F.explode("rest").alias("key")).join(values.select("key", "v"), "key")
    late = late.groupBy("uid").agg(
        F.sum(F.when(is_word, F.col("v"))).alias("base_late"), F.count(F.when(is_word, 1)).alias("known_late"),
        F.sum(F.when(~is_word, F.col("v"))).alias("score_late"))
    nothing = math.log10(SMOOTHING / model.whole)
    known = F.col("n_known") + F.coalesce("known_late", F.lit(0))
    base = F.col("base_score") + F.coalesce("base_late", F.lit(0.0)) + (F.col("n_tokens") - known) * nothing
    return sums.drop("rest").join(late, "uid", "left").select(
        "doc_id", "n_tokens", known.alias("n_known"), base.alias("base_score"),
        (F.col("score") + F.coalesce("score_late", F.lit(0.0))).alias("score"))


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    held_out: Column = crc_of_id(F.col("doc_id")) % 10 == 0
    docs = read(spark, folder, "documents").select("doc_id", "text", (~held_out).alias("train"))
    model = fit(docs)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


class Trie:
    """The same model symbol by symbol, for adaptive coding: it learns each symbol after pricing it."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, defaultdict(lambda: defaultdict(int))

    def price(self, past: bytes, symbol: int) -> float:
        """log10 probability of the symbol behind the past (its last ``order`` bytes)."""
        out, excluded = 0.0, set()
        for depth in range(self.order, -1, -1):
            followers = {s: n for s, n in self.seen.get(past[len(past) - depth:], {}).items() if s not in excluded}
            total, kinds = sum(followers.values()), len(followers)
            if symbol in followers:
                return out + math.log10(followers[symbol] / (total + kinds))
            if total:
                out += math.log10(kinds / (total + kinds))
                excluded |= followers.keys()
        return out - math.log10(SYMBOLS - len(excluded))

    def learn(self, past: bytes, symbol: int) -> None:
        for depth in range(self.order + 1):
            self.seen[past[len(past) - depth:]][symbol] += 1

    def text(self, data: bytes, price: bool = True, learn: bool = True) -> float:
        """Runs over a text and its end; the log10 probability if it is to be priced."""
        past, out = bytes([PAD]) * self.order, 0.0
        for symbol in (*data, END):
            out += self.price(past, symbol) if price else 0.0
            if learn:
                self.learn(past, symbol)
            past = (past + bytes([symbol]))[-self.order:] if self.order else b""
        return out


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, adaptive_score: log10 probability of each text by a model that starts empty with the text.

    It reads one text at a time and keeps that text's trie only. Null texts are empty.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [Trie(order).text((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "adaptive_score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(coded, "doc_id long, adaptive_score double")
