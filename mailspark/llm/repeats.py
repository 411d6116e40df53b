"""Removal of word passages that other documents hold as well, by level-wise doubling of window lengths.

Windows are first compared at a short length; only where a short window repeats in another text is the text looked at
again with windows twice as long, and so on up to the wanted length or until nothing survives. Each level is one
grouping of 64-bit window keys and one join back to the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read, stored
from mailspark.llm.words import Chunk, chunks, mixed, signed, unsigned, window_keys

WINDOW = 13
LEAST = 7
_ROW = np.uint64(0xA24BAED4963EE407)


def ladder(window: int, least: int = LEAST) -> list[int]:
    """Window lengths, each at most twice the one before, the last one the wanted length."""
    lengths = [window]
    while lengths[0] > least and lengths[0] > 1:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths if len(lengths) > 1 else [window, window]


def _owned(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key + row.astype(np.uint64) * _ROW)


def _listed(batch: pa.RecordBatch, chunk: Chunk, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys stand in the key list of their own row."""
    part = batch["keys"].slice(chunk.first, chunk.rows)
    sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    if not sizes.sum() or not len(key):
        return np.zeros(len(key), bool)
    return np.isin(_owned(row, key), _owned(np.repeat(np.arange(chunk.rows), sizes), unsigned(part.flatten().to_numpy())))


class _Anchors:
    """The short windows of a chunk that are the least of some longer window: equal longer windows have equal ones.

    Only these need to be compared at the first level, about 2 in (longer - shorter + 2).
    """

    def __init__(self, chunk: Chunk, short: int, long: int):
        self.short = window_keys(chunk.key, short)
        self.starts = chunk.window_starts(long)
        self.reach = long - short + 1
        size = max(0, len(chunk.key) - long + 1)
        self.valid = np.zeros(size, bool)
        self.valid[self.starts] = True
        self.least = self.short[:size].copy()
        for o in range(1, self.reach):
            np.minimum(self.least, self.short[o:o + size], out=self.least)

    def positions(self) -> np.ndarray:
        marked, size = np.zeros(len(self.short), bool), len(self.least)
        for o in range(self.reach if size else 0):
            marked[o:o + size] |= self.valid & (self.short[o:o + size] == self.least)
        return np.flatnonzero(marked)

    def windows(self, marked: np.ndarray) -> np.ndarray:
        """Starts of longer windows whose least short window is marked."""
        found, size = np.zeros(len(self.least), bool), len(self.least)
        for o in range(self.reach if size else 0):
            found |= marked[o:o + size] & (self.short[o:o + size] == self.least)
        return np.flatnonzero(found & self.valid)


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[first], key[first]


def _pairs(batch: pa.RecordBatch, column: str, chunk: Chunk, at: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    row, key = _distinct(chunk.row_of_word()[at], key)
    owner = batch[column].slice(chunk.first, chunk.rows).take(pa.array(row))
    return pa.record_batch([pa.array(signed(key)), owner], names=["key", column])


def _repeated(pairs: DataFrame, column: str) -> DataFrame:
    """Keys that stand in more than one place, with the first of these."""
    held = pairs.groupBy("key").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return held.where("first < last").select("key", "first")


def removable(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, keys: the windows of each document that also start in a document with a smaller id; copied: the whole
    text stands in such a document.

    Exact copies of a text leave after the first level, which compares texts instead of documents: all windows of
    the copies with larger ids are in the one with the smallest. Rows with a null id take no part.
    """
    lengths = ladder(window, least)
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("t"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"]):
                found = _Anchors(chunk, lengths[0], lengths[1])
                at = found.positions()
                yield _pairs(batch, "t", chunk, at, found.short[at])

    pairs = whole.select("text", "t").mapInArrow(anchors, "key long, t long")
    marked = pairs.join(_repeated(pairs, "t").select("key").hint("shuffle_hash"), "key").groupBy("t").agg(
        F.collect_set("key").alias("keys"))
    ids = whole.select("doc_id", "t", F.md5(F.encode("text", "UTF-8")).alias("m"))
    firsts = ids.groupBy("t", "m").agg(F.min("doc_id").alias("rep"))
    marks = stored(firsts.join(marked, "t").groupBy("rep").agg(F.flatten(F.collect_list("keys")).alias("keys"))
                   .select(F.col("rep").alias("doc_id"), "keys"), "anchors")

    def extended(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch["keys"]))
                for chunk in chunks(batch["text"]):
                    row, long = chunk.row_of_word(), lengths[level]
                    if level == 1:
                        found = _Anchors(chunk, lengths[0], long)
                        at = found.positions()
                        on = np.zeros(len(found.short), bool)
                        on[at[_listed(batch, chunk, row[at], found.short[at])]] = True
                        at = found.windows(on)
                    else:  # both ends of the longer window repeat
                        short = lengths[level - 1]
                        at, key = chunk.windows(short)
                        on = np.zeros(len(row) + 1, bool)
                        on[at[_listed(batch, chunk, row[at], key)]] = True
                        at = chunk.window_starts(long)
                        at = at[on[at] & on[at + long - short]]
                    yield _pairs(batch, "doc_id", chunk, at, window_keys(chunk.key, long)[at])
        return run

    texts = docs.select("doc_id", "text")
    for level in range(1, len(lengths)):
        last = level == len(lengths) - 1
        pairs = texts.join(marks, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(
            extended(level), "key long, doc_id long")
        hits = pairs.join(_repeated(pairs, "doc_id"), "key").where(F.col("doc_id") > F.col("first") if last else F.lit(True))
        marks = hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        marks = marks if last else stored(marks, f"windows-{lengths[level]}")
    copied = ids.join(firsts, ["t", "m"]).where(F.col("doc_id") > F.col("rep")).select("doc_id").distinct()
    return marks.join(copied.withColumn("copied", F.lit(True)), "doc_id", "full_outer")


def _cut(chunk: Chunk, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, text by text."""
    kept = np.flatnonzero(~gone)
    row = chunk.row_of_word()[kept]
    start, end = chunk.start[kept], chunk.end[kept].copy()
    inner = np.zeros(len(kept), bool)
    inner[:-1] = row[:-1] == row[1:]
    data = chunk.data.copy()
    data[end[inner]] = 0x20
    end[inner] += 1
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, end, 1)
    stays = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    at = np.concatenate([[0], np.cumsum(stays)])[chunk.text_at]
    return pa.LargeStringArray.from_buffers(chunk.rows, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[stays].tobytes()))


def dedupe(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` consecutive words covers it that also starts in a document with a smaller
    doc_id; windows are judged on the input. ``kept`` holds the other words, joined by one space.

    Null and empty texts have no words. Texts of fewer than ``window`` words keep all. Rows that repeat a doc_id are
    cut alike by what smaller ids hold, and not by each other. A null doc_id loses nothing and takes from no one.
    """
    marks = removable(docs, window, least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = pc.fill_null(batch["copied"], False).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch["text"]):
                row = chunk.row_of_word()
                at, key = chunk.windows(window)
                hit = _listed(batch, chunk, row[at], key) | copied[chunk.first + row[at]]
                edge = np.zeros(len(row) + window + 1, np.int32)
                edge[at[hit]] += 1
                edge[at[hit] + window] -= 1
                gone = np.cumsum(edge)[:len(row)] > 0
                yield pa.record_batch([
                    batch["doc_id"].slice(chunk.first, chunk.rows), pa.array(chunk.counts()),
                    pa.array(np.bincount(row[gone], minlength=chunk.rows)), _cut(chunk, gone).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    marked = docs.select("doc_id", "text").join(marks, "doc_id", "left").select("doc_id", "text", "keys", "copied")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    done = dedupe(read(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
