"""Token counts by a linear longest-match automaton over a fixed vocabulary of word pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read
from mailspark.llm.words import Lookup, chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands before the first letter of a word in the vocabulary; pieces without it continue a word.
WORD_START = "▁"
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 1 << 19


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The plain pieces of a sentencepiece model: no control, unknown or byte pieces. Read on the driver alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]


class Matcher:
    """Greedy longest-match-first piece counts in time linear in the word.

    States are the vocabulary trie's. ``fail[v]`` is the state that matching resumes in when no child fits, after the
    pieces that were certain by then are popped; ``popped[v]`` counts these. Both follow from the parent's: a state
    that is a piece pops itself and resumes at the root; any other pops what its parent would, plus what the states
    on the way pop, until a child with its letter is found. A state without failure link is a dead end: its word
    has no full cover.
    """

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        is_piece = {0: False}
        for piece in pieces:
            at = 0
            for letter in piece:
                if letter not in self.child[at]:
                    self.child[at][letter] = len(self.child)
                    is_piece[len(self.child)] = False
                    self.child.append({})
                at = self.child[at][letter]
            is_piece[at] = at > 0
        self.fail, self.popped = [-1] * len(self.child), [0] * len(self.child)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for letter, at in self.child[parent].items():
                queue.append(at)
                if is_piece[at]:
                    self.fail[at], self.popped[at] = 0, 1
                    continue
                back, pops = self.fail[parent], self.popped[parent]
                while back >= 0 and letter not in self.child[back]:
                    pops += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[at], self.popped[at] = self.child[back][letter], pops

    def pieces(self, word: str) -> int:
        """Number of pieces that cover the word, or -1 if longest matches do not cover it."""
        child, fail, popped = self.child, self.fail, self.popped
        at = total = 0
        for letter in word:
            while letter not in child[at]:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = child[at][letter]
        while at:
            total += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return total


def token_counts(docs: DataFrame, pieces: list[str], unknown: int = 1) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row of ``docs`` (doc_id, text).

    Words are runs outside 0x20 and 0x09-0x0D. A word counts the pieces that greedy longest-match-first finds in
    WORD_START + word; a word that these do not cover is one of n_unknown and counts ``unknown`` tokens. The
    vocabulary is a fixed list and travels to every task; a word is matched once per task and then remembered by its
    64-bit key, in bounded memory.

    Null and empty texts have no words. A null doc_id keeps its row; rows that repeat a doc_id are rows of their own.
    """
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(pieces))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher.value
        keys, sizes = np.zeros(0, np.uint64), np.zeros(1, np.int32)
        table, fresh = Lookup(keys), {}
        for batch in batches:
            for chunk in chunks(batch["text"]):
                at = table.find(chunk.key)
                size = sizes[at]
                for k in np.flatnonzero(at < 0).tolist():
                    key = int(chunk.key[k])
                    n = fresh.get(key)
                    if n is None:
                        word = chunk.data[chunk.start[k]:chunk.end[k]].tobytes().decode("utf-8", "replace")
                        n = fresh[key] = match.pieces(WORD_START + word)
                    size[k] = n
                row = chunk.row_of_word()
                lost = size < 0
                size[lost] = unknown
                yield pa.record_batch([
                    batch["doc_id"].slice(chunk.first, chunk.rows), pa.array(chunk.counts()),
                    pa.array(np.bincount(row, size, chunk.rows).astype(np.int64)),
                    pa.array(np.bincount(row[lost], minlength=chunk.rows))],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown"])
                if len(fresh) > max(1 << 14, len(keys) // 2):
                    if len(keys) + len(fresh) > REMEMBERED:
                        keys, sizes = np.zeros(0, np.uint64), np.zeros(1, np.int32)
                    keys = np.concatenate([keys, np.fromiter(fresh.keys(), np.uint64, len(fresh))])
                    sizes = np.concatenate([sizes[:-1], np.fromiter(fresh.values(), np.int32, len(fresh)), [0]]).astype(np.int32)
                    table, fresh = Lookup(keys), {}

    schema = "doc_id long, n_words long, n_tokens long, n_unknown long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, schema)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents").select("doc_id", "text"), load_pieces())
