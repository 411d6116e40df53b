"""Quality rules: statistics of texts, and decision lists that sequential covering learns from labelled statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read, stored
from mailspark.llm.words import Chunk, chunks, mixed, span_keys, window_keys

#: Labelled rows that the rules are learned from, at most.
LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks")
_ROW = np.uint64(0xA24BAED4963EE407)


def _table(symbols: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(symbols)] = 1
    return out


_SYMBOLS, _DIGITS, _MARKS = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(b"!?")
_CAPITALS = _table(bytes(range(65, 91)))
_LEADS = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # one in each code point


def _per_text(chunk: Chunk, marks: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[chunk.text_at])


def _within(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key + row.astype(np.uint64) * _ROW)


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and lines among them that equal an earlier one, of each text."""
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.unique(np.concatenate([chunk.text_at[:-1], breaks + 1]))
    start = start[start < len(chunk.data)]
    row = np.searchsorted(chunk.text_at, start, "right") - 1
    ends = np.append(breaks, len(chunk.data))
    end = np.minimum(ends[np.searchsorted(breaks, start)], chunk.text_at[row + 1])
    filled = np.searchsorted(chunk.start, start) < np.searchsorted(chunk.start, end)
    row, start, end = row[filled], start[filled], end[filled]
    _, first = np.unique(_within(row, span_keys(chunk.data, start, end)), return_index=True)
    n = np.bincount(row, minlength=chunk.rows)
    return n, n - np.bincount(row[first], minlength=chunk.rows)


def _repeat_words(chunk: Chunk, n: int = 3) -> np.ndarray:
    """Words of each text in windows of n words that the text has twice or more."""
    row = chunk.row_of_word()
    at = chunk.window_starts(n)
    if not len(at):
        return np.zeros(chunk.rows, np.int64)
    _, inverse, times = np.unique(_within(row[at], window_keys(chunk.key, n)[at]), return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    edge = np.zeros(len(row) + n + 1, np.int32)
    edge[twice] += 1
    edge[twice + n] -= 1
    return np.bincount(row[np.cumsum(edge)[:len(row)] > 0], minlength=chunk.rows)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of ``docs`` (doc_id, text).

    word_chars: code points in words. n_symbols: characters of #*$%&|<>. n_lines: lines (split at line feeds) with a
    word; n_dup_lines: those that equal an earlier one. n_repeat_words: words in three-word windows that the text has
    twice or more. n_capitals: A-Z. n_digits: 0-9. n_marks: ! and ?. All are 0 for null and empty texts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"]):
                leads = _LEADS[chunk.data]
                inside = np.zeros(len(chunk.data) + 1, np.int8)
                inside[chunk.start] += 1
                inside[chunk.end] -= 1
                lines, copies = _lines(chunk)
                columns = [
                    chunk.counts(), _per_text(chunk, leads * np.cumsum(inside[:-1], dtype=np.int8)),
                    _per_text(chunk, _SYMBOLS[chunk.data]), copies, _repeat_words(chunk), lines,
                    _per_text(chunk, _CAPITALS[chunk.data]), _per_text(chunk, _DIGITS[chunk.data]),
                    _per_text(chunk, _MARKS[chunk.data])]
                yield pa.record_batch([batch["doc_id"].slice(chunk.first, chunk.rows),
                                       *[pa.array(c.astype(np.int64)) for c in columns]], names=["doc_id", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, schema)


def features() -> dict[str, Column]:
    """The figures that rules may test: lengths, and rates that do not depend on the length."""
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "letters_per_word": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"), "copied_lines": rate("n_dup_lines", "n_lines"),
        "repeated_words": rate("n_repeat_words", "n_words"), "capital_rate": rate("n_capitals", "word_chars"),
        "digit_rate": rate("n_digits", "word_chars"), "mark_rate": rate("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.above else x[self.feature] <= self.bound

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Test, ...]


def _covered(rule: Sequence[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> list[Test]:
    """Adds the test with the highest information gain until no good row is covered or nothing is gained."""
    rule, inside = [], np.ones(len(bad), bool)
    while (inside & ~bad).any() and len(rule) < 8:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        before, best, best_gain = np.log2(p / (p + n)), None, 1e-9
        for name, values in x.items():
            order = np.argsort(values[inside], kind="stable")
            v, b = values[inside][order], bad[inside][order]
            edges = np.flatnonzero(v[1:] > v[:-1])
            if len(edges) > cuts:
                edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
            below_p = np.cumsum(b)[edges]
            below_n = edges + 1 - below_p
            for above, ps, ns in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1)) - before), 0)
                if len(gain) and gain.max() > best_gain:
                    k = edges[int(np.argmax(gain))]
                    best, best_gain = Test(name, above, float((v[k] + v[k + 1]) / 2)), gain.max()
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Drops the last tests where that does not worsen (p - n) / (p + n) on rows that the rule was not grown on."""
    def worth(k: int) -> float:
        hit = _covered(rule[:k], x, len(bad))
        return (2 * (hit & bad).sum() - hit.sum()) / max(1, hit.sum())
    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 3, cuts: int = 512,
          most: int = 32) -> list[Rule]:
    """An ordered list of conjunctions that cover bad rows, by sequential covering.

    Two rows in three grow a rule, the third prunes it; rows that it covers leave, and the next rule is grown on the
    rest. The list ends when a rule covers fewer than ``support`` bad rows or its precision on all rows that are left
    is below ``precision``. Without bad or without good rows there are no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prune = np.arange(len(bad)) % 3 == 2
    while bad.any() and not bad.all() and (left & bad & ~prune).any() and len(rules) < most:
        part = lambda which: ({k: v[which] for k, v in x.items()}, bad[which])  # noqa: E731, B023
        rule = _prune(_grow(*part(left & ~prune), cuts), *part(left & prune))
        hit = _covered(rule, x, len(bad)) & left
        right = (hit & bad).sum()
        if not rule or right < support or right < precision * hit.sum():
            break
        rules.append(tuple(rule))
        left &= ~hit
    return rules


def decision(rules: Sequence[Rule], covered: Column, otherwise: Column) -> Column:
    """The list as one conditional expression: the first rule that holds decides."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for test in rule[1:]:
            holds = holds & test.column()
        out = F.when(holds, covered) if out is None else out.when(holds, covered)
    return otherwise if out is None else out.otherwise(otherwise)


def fit(stats: DataFrame, labels: DataFrame, most: int = LABELLED, **options) -> list[Rule]:
    """Rules for labelled rows (doc_id, quality) of ``stats``; a sample of ``most`` rows by a hash of the id.

    Null ids and null labels are left out; of several labels of one id the lowest counts. The sample has eight
    figures a row, so what reaches the driver is bounded by ``most``.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (stats.join(known, "doc_id").select("doc_id", (F.col("quality") == 0).alias("bad"),
                                               *[c.alias(n) for n, c in features().items()])
            .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)).toArrow()
    x = {name: rows[name].to_numpy() for name in features()}
    return learn(x, rows["bad"].to_numpy(), **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed and kept of every row of ``docs`` (doc_id, text), and the rules behind them.

    The rules are learned on labelled rows that pass the base limits. kept is false where these fail or a rule holds.
    Null and empty texts fail the base limits. Empty tables, or no labels, give no rules.
    """
    stats = stored(statistics(docs), "statistics")
    rules = fit(stats.where(~base_failed()), labels, **options)
    verdict = decision(rules, F.lit(False), F.lit(True))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict), rules


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = judge(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
