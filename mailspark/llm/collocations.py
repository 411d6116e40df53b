"""Phrase collocations by partitioned mining.

A phrase that occurs ``support`` times among n words occurs, in one shard of w words at least, support * w / n times or
more. So each shard is mined completely at that lower support, level by level; the union of what is frequent in some
shard holds every frequent phrase, and all of these are then counted over everything.

Where there are so many shards that this lower support falls below LEAST, shards would name nearly all of their phrases.
Then they meet after each level: they name what phrases of that length they have, their counts are added up, and only what
is frequent over everything is built upon at the next length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailspark.llm.tables import read, stored
from mailspark.llm.words import CHUNK, Lookup, buffers, lists, mixed, signed, span_keys, unsigned, window_keys

LONGEST = 5
SUPPORT = 100
#: A longer phrase that occurs so many percent as often as a candidate stands for it.
COVERED = 100
FIRST = 2_000
UNLABELLED = "und"
#: Words of a shard, at least; a task cuts what it reads into shards of this to twice this size, and mines one at a time.
SHARD = 3 << 20
#: Shards meet after each level where their share of the support, for the smallest of them, is below this. Mined alone at a
#: lower share they name so much that an executor's memory runs short.
LEAST = 16
#: Places of a phrase that tell its words then, of all that it has, and what stands for none.
TOLD, NEVER = 6, 100
#: Words of the input for each bucket in which shards' phrases meet.
BUCKET = 1 << 20
#: Keys of phrases that are sent to the tasks; more of them are met in a shuffle.
TRAVEL = 1 << 21
#: Marks of the bitmap that then goes to the tasks, as a power of two.
BITS = 27
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some texts, in order."""

    data: np.ndarray   # lowered bytes
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray    # 64 bits of language and word
    lang: np.ndarray   # the language's number
    piece: np.ndarray  # ascending numbers of pieces

    def word(self, at: int) -> bytes:
        return self.data[self.start[at]:self.end[at]].tobytes()


def words(texts: pa.Array, lang: np.ndarray, salts: np.ndarray, size: int = CHUNK) -> Iterator[Words]:
    """The words of all texts, about ``size`` bytes at a time; ``lang`` numbers each text's language."""
    data, at = buffers(texts)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        part, edge = _LOWER[data[at[first]:at[stop]]], at[first:stop + 1] - at[first]
        inside = ~_OUTSIDE[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        some = np.diff(edge) > 0
        begins[edge[:-1][some]] = inside[edge[:-1][some]]
        ends[edge[1:][some] - 1] = inside[edge[1:][some] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(edge, start, "right") - 1
        piece = np.cumsum(_BREAK[part])[start] + row if len(start) else start  # both only grow, so no two pieces share a number
        of = lang[first:stop][row]
        yield Words(part, start, end, mixed(span_keys(part, start, end) ^ salts[of]), of, piece)
        first = stop


def language_salts(names: list[str]) -> np.ndarray:
    """A number for each language that depends on its name only."""
    raw = [n.encode() for n in names]
    at = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return mixed(span_keys(data, at[:-1], at[1:]) if len(raw) else np.zeros(0, np.uint64))


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


@dataclass
class Phrases:
    """What a shard finds frequent in one language."""

    size: np.ndarray
    key: np.ndarray    # as window_keys() gives them
    n: np.ndarray
    parts: np.ndarray  # keys of each phrase's words, one phrase behind the other
    text: list         # of phrases of one word; None for others


class Shard:
    """Words of one shard, and its complete mining. ``names`` are the languages that the task has met, by number."""

    def __init__(self, room: int):
        self.names: dict[str, int] = {}
        self.held: list[Words] = []
        self.room, self.size = room, 0

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(name, len(self.names)) for name in names], np.int64)

    def add(self, found: Words) -> list[Words]:
        """Holds the words, their pieces as marks of words in one piece with the word before.

        Once there are twice ``room``, what makes up the first half is given out, so that no shard of a task is a small
        rest, which would have to name nearly all of its phrases.
        """
        found.piece = np.append(False, found.piece[1:] == found.piece[:-1])[:len(found.piece)]
        found.start, found.end, found.lang = (v.astype(np.int32) for v in (found.start, found.end, found.lang))
        self.held.append(found)
        self.size += len(found.start)
        if self.size < 2 * self.room:
            return []
        out, n = [], 0
        while n < self.room:
            out.append(self.held.pop(0))
            n += len(out[-1].start)
        self.size -= n
        return out

    def mined(self, held: list[Words], totals: dict[str, int], support: int, longest: int) -> Iterator[tuple[str, int, Phrases]]:
        """language, least, phrases: those whose count in ``held`` reaches their language's share of ``support``.

        Words are numbered; a phrase of m words is numbered through the pair of its first and its last m - 1 words, and
        looked at only where both are frequent here, so no two phrases of a shard are mixed up.
        """
        key, lang, joined = (np.concatenate([getattr(w, c) for w in held]) for c in ("key", "lang", "piece"))
        for w in held:
            w.key = w.lang = w.piece = None
        begins = np.cumsum([0] + [len(w.start) for w in held])
        here = np.bincount(lang, minlength=len(self.names))
        all_ = np.array([max(totals.get(n, 0), 1) for n in self.names])
        least = np.array([max(1, -(-support * int(w) // int(n))) for w, n in zip(here, all_)])
        at, number, out = np.arange(len(key), dtype=np.int32), key, []
        for m in range(1, longest + 1):
            number, first, n = _numbered(number)
            kept = n >= least[lang[at[first]]]
            out.append((np.full(kept.sum(), m), at[first[kept]], n[kept]))
            stay = kept[number]
            at, number = at[stay], np.cumsum(kept, dtype=np.int32)[number[stay]] - np.int32(1)
            if m == longest or len(at) < 2:
                break
            follows = np.flatnonzero((at[1:] == at[:-1] + 1) & joined[at[:-1] + m])
            number = number[follows] * np.int64(kept.sum()) + number[follows + 1]
            at = at[follows]
        size, spot, n = (np.concatenate(c) for c in zip(*out))
        for name, k in self.names.items():
            if not here[k]:
                continue
            mine = lang[spot] == k
            sizes, spots = size[mine], spot[mine]
            full = np.concatenate([_keys(key, spots[sizes == m], m) for m in range(1, longest + 1)])  # sizes ascend
            words_at = np.repeat(spots, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            text = [held[c].word(i - begins[c]) for c, i in zip(
                (np.searchsorted(begins, spots[sizes == 1], "right") - 1).tolist(), spots[sizes == 1].tolist())]
            yield name, int(least[k]), Phrases(sizes, full, n[mine], _keys(key, words_at, 1), text + [None] * int((sizes > 1).sum()))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A dense number of each value, one place of each distinct value, and how often it occurs; in 32 bits, and nothing
    is kept longer than needed, as this is what most of a task's memory goes to."""
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    del values
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32)
    number -= 1
    start = np.flatnonzero(new)
    return number, order[start], np.diff(np.append(start, len(order)))


def _keys(key: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """window_keys of the windows of m entries at some places."""
    return window_keys(key[at + np.arange(m)[:, None]], m)[0] if len(at) else np.zeros(0, np.uint64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang"), F.lit(UNLABELLED)).alias("lang")).where("text IS NOT NULL")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, n: how many words the texts of each language have; ``docs`` as texts_of() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            data, at = buffers(batch["text"])
            number, names = _languages(batch["lang"])
            for first in range(0, len(batch), 256):
                edge = at[first:first + 257] - at[first]
                inside = ~_OUTSIDE[data[at[first]:at[first] + edge[-1]]]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                begins[edge[:-1][np.diff(edge) > 0]] = inside[edge[:-1][np.diff(edge) > 0]]
                n = np.diff(np.concatenate([[0], np.cumsum(begins)])[edge])
                for name, k in zip(names, np.bincount(number[first:first + 256], n, len(names)).astype(int).tolist()):
                    held[name] = held.get(name, 0) + k
        yield pa.record_batch([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "n"])

    return docs.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, totals: DataFrame, support: int, longest: int = LONGEST, shard: int = SHARD, room: int = BUCKET) -> DataFrame:
    """What each shard of ``docs`` finds frequent: size, key, n, parts and text of its phrases as lists, dealt into
    buckets by key, with the count that this took in the shard.

    A task reads its rows in shards of ``shard`` to twice as many words (a task with fewer is one shard). Every shard
    has a row of bucket 0 for each of its languages. There is a bucket for every ``room`` words of the input.
    """
    known = dict(totals.collect())
    buckets = np.uint64(max(1, sum(known.values()) // room))

    def packed(name: str, least: int, found: Phrases) -> pa.RecordBatch:
        bucket = (found.key % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        number, counts = np.unique(np.append(bucket, 0), return_counts=True)
        counts[0] -= 1
        size = found.size[order]
        starts = (np.cumsum(found.size) - found.size)[order]
        parts = found.parts[np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        listed = lambda v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), v)
        text = pa.array([found.text[k] for k in order.tolist()], pa.binary()).cast(pa.string())
        return pa.record_batch([
            pa.array([name] * len(number), pa.string()), pa.array(number, pa.int32()), pa.array(np.full(len(number), least, np.int64)),
            listed(pa.array(size.astype(np.int8))), listed(pa.array(signed(found.key[order]))), listed(pa.array(found.n[order])),
            pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(parts))), listed(text)],
            names=["lang", "bucket", "least", "size", "key", "n", "parts", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(shard)
        for batch in batches:
            number, names = _languages(batch["lang"])
            number = held.numbers(names)[number] if len(batch) else number
            for found in words(batch["text"], number, language_salts(list(held.names))):
                if full := held.add(found):
                    yield from (packed(*x) for x in held.mined(full, known, support, longest))
        if held.size:
            yield from (packed(*x) for x in held.mined(held.held, known, support, longest))
        del held
        pa.default_memory_pool().release_unused()  # the worker lives on, beside those of other tasks

    return docs.mapInArrow(run, "lang string, bucket int, least long, size array<byte>, key array<long>, n array<long>, "
                                "parts array<long>, text array<string>")


def candidates(local: DataFrame, support: int) -> DataFrame:
    """lang, size, key, parts, text of the phrases that may occur ``support`` times; with a phrase all its parts.

    A shard that does not name a phrase has it at most its least count - 1 times. So the counts of those that name it,
    with that much from each of the others, bound the whole; phrases whose bound is too low are no candidates. Lists of
    one bucket meet in one task, which adds them up.
    """
    slack = {r.lang: r.slack for r in local.where("bucket = 0").groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack")).collect()}

    def merged(lang: str, held: list[tuple]) -> pa.RecordBatch:
        size, key, over, parts, text = (np.concatenate(c) for c in list(zip(*held))[:5])
        number, first, _ = _numbered(key)
        total = np.bincount(number, over, len(first)).astype(np.int64)
        at = first[total + slack[lang] >= support]
        begin = np.cumsum(size) - size
        return pa.record_batch([
            pa.array([lang] * len(at), pa.string()), pa.array(size[at].astype(np.int8)), pa.array(key[at]),
            lists(parts[np.repeat(begin[at], size[at]) + np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])], size[at]),
            pa.array(text[at], pa.string())], names=["lang", "size", "key", "parts", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, (lang, bucket, least) in enumerate(zip(*(batch[c].to_pylist() for c in ("lang", "bucket", "least")))):
                if (lang, bucket) != now and held:
                    yield merged(now[0], held)
                    held = []
                now = lang, bucket
                size, key, n, parts, text = (batch[c][i].values for c in ("size", "key", "n", "parts", "text"))
                if len(key):
                    held.append((size.to_numpy().astype(np.int64), key.to_numpy(), n.to_numpy() - least + 1, parts.to_numpy(),
                                 text.to_numpy(zero_copy_only=False)))
        if held:
            yield merged(now[0], held)

    met = local.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return met.mapInArrow(run, "lang string, size byte, key long, parts array<long>, text string")


def _marks(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2 ** ``bits`` marks with those of ``keys`` (key) set."""
    at = F.col("key").bitwiseAND((1 << bits) - 1)
    marks = keys.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("marks")).toArrow()
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    bitmap[marks["byte"].to_numpy()] = marks["marks"].to_numpy()
    return bitmap


def _marked(bitmap: np.ndarray):
    mask = np.uint64(8 * len(bitmap) - 1)

    def marked(_, keys: np.ndarray) -> np.ndarray:
        at = keys & mask
        return np.where(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1, np.arange(len(keys)), -1)

    return marked


def level(docs: DataFrame, m: int, shorter: DataFrame | None, support: int, buckets: int, shard: int, bits: int = BITS) -> DataFrame:
    """size, key, n of the phrases of ``m`` words that occur ``support`` times, given the frequent ones of fewer words
    (``shorter``: key; None for single words).

    Each shard names its windows of m words whose shorter windows are all marked, and how often it has them; lists of one
    bucket meet in one task, which adds them up. A mark set by another phrase costs a name more and changes no count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if shorter is None else _marks(shorter, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = None if shared.value is None else _marked(shared.value)
        held: list[np.ndarray] = []

        def named() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            number, counts = np.unique(bucket, return_counts=True)
            yield pa.record_batch([pa.array(number, pa.int32()), lists(signed(key[order]), counts), lists(n[order].astype(np.int32), counts)],
                                  names=["bucket", "key", "n"])

        for batch in batches:
            number, names = _languages(batch["lang"])
            for found in words(batch["text"], number, language_salts(names)):
                before = None
                for k in range(1, m):
                    before, _ = _hits(found, k, before, marked)
                at = _windows(found, m, before)
                if len(at):
                    held.append(_keys(found.key, at, m))
                if sum(map(len, held)) >= 2 * shard:
                    yield from named()
        if held:
            yield from named()
        pa.default_memory_pool().release_unused()

    def merged(held: list[tuple]) -> pa.RecordBatch:
        key, n = (np.concatenate(c) for c in zip(*held))
        number, first, _ = _numbered(key)
        total = np.bincount(number, n, len(first)).astype(np.int64)
        often = total >= support
        return pa.record_batch([pa.array(np.full(often.sum(), m, np.int8)), pa.array(key[first[often]]), pa.array(total[often])], names=["size", "key", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, bucket in enumerate(batch["bucket"].to_pylist()):
                if bucket != now and held:
                    yield merged(held)
                    held = []
                now = bucket
                held.append((batch["key"][i].values.to_numpy(), batch["n"][i].values.to_numpy()))
        if held:
            yield merged(held)

    met = docs.mapInArrow(run, "bucket int, key array<long>, n array<int>").repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(added, "size byte, key long, n long")


def _told(docs: DataFrame, found: DataFrame, longest: int, bits: int, times: int) -> DataFrame:
    """key, lang, parts, text of windows of ``docs`` that are phrases of ``found`` (key, odds): one in 2 ** odds of them
    times ``times``, none where odds is NEVER. Some may be other windows, with other keys.

    A table of 2 ** ``bits`` bytes goes to the tasks.
    """
    cells = found.select(F.col("key").bitwiseAND((1 << bits) - 1).cast("int").alias("cell"), F.col("odds").cast("byte").alias("odds"))
    cells = cells.groupBy("cell").agg(F.min("odds").alias("odds")).toArrow()
    table = np.full(1 << bits, -1, np.int8)
    table[cells["cell"].to_numpy()] = cells["odds"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = shared.value, np.uint64((1 << bits) - 1)
        rng = np.random.default_rng(TaskContext.get().partitionId())
        share = np.append(np.minimum(1.0, times * 0.5 ** np.arange(NEVER)), 0.0)
        hit = lambda _, keys: table[keys & mask]
        for batch in batches:
            number, names = _languages(batch["lang"])
            for some in words(batch["text"], number, language_salts(names)):
                before = None
                for m in range(1, longest + 1):
                    before, odds = _hits(some, m, before, hit)
                    if not len(before):
                        break
                    at = before[rng.random(len(before)) < share[odds]]
                    key, first = np.unique(_keys(some.key, at, m), return_index=True)
                    if not len(key):
                        continue
                    at = at[first]
                    text = [some.word(i) for i in at.tolist()] if m == 1 else [None] * len(at)
                    yield pa.record_batch([
                        pa.array(signed(key)), pa.array([names[k] for k in some.lang[at].tolist()], pa.string()),
                        lists(signed(_keys(some.key, (at[:, None] + np.arange(m)).ravel(), 1)), np.full(len(at), m)),
                        pa.array(text, pa.binary()).cast(pa.string())], names=["key", "lang", "parts", "text"])

    rows = docs.mapInArrow(run, "key long, lang string, parts array<long>, text string")
    return rows.dropDuplicates(["key"]).join(found.where(F.col("odds") < NEVER).select("key"), "key", "left_semi")


def spelled(docs: DataFrame, found: DataFrame, longest: int = LONGEST, bits: int = BITS - 2, times: int = TOLD) -> DataFrame:
    """``found`` (size, key, n) with lang, the keys of each phrase's words (``parts``) and the text of single words.

    Of a phrase's n places, ``times`` to twice as many tell these, drawn at random, so that the rows follow the number of
    phrases and not that of tasks. Those that no drawn place told are then told by all of theirs.
    """
    told = stored(_told(docs, found.select("key", F.floor(F.log2("n")).alias("odds")), longest, bits, times), "told")
    known = told.select("key", F.lit(True).alias("known"))
    rest = stored(found.join(known, "key", "left").select("key", F.when(F.col("known"), NEVER).otherwise(0).alias("odds")), "rest")
    if not rest.where("odds = 0").isEmpty():
        told = told.unionByName(_told(docs, rest, longest, bits, 1))
    return found.join(told, "key")


def in_levels(docs: DataFrame, words_in_all: int, support: int, longest: int = LONGEST, shard: int = SHARD, room: int = BUCKET,
              bits: int = BITS) -> DataFrame:
    """lang, size, key, n, parts, text of the phrases that occur ``support`` times, by shards that meet after each level."""
    found = None
    for m in range(1, longest + 1):
        more = stored(level(docs, m, found, support, max(1, words_in_all // room), shard, bits), "level")
        found = more if found is None else found.unionByName(more)
        if more.isEmpty():
            break
    return spelled(docs, found, longest, bits - 2)


def _windows(found: Words, m: int, before: np.ndarray | None) -> np.ndarray:
    """Places of windows of m words within a piece whose two parts of m - 1 words are at the places ``before``."""
    at = np.arange(len(found.start)) if before is None else before[:-1][before[1:] == before[:-1] + 1]
    return at[found.piece[at + m - 1] == found.piece[at]]


def _hits(found: Words, m: int, before: np.ndarray | None, hit) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of m words within a piece whose two parts of m - 1 words were hits, and what ``hit`` finds there."""
    at = _windows(found, m, before)
    place = hit(m, _keys(found.key, at, m))
    return at[place >= 0], place[place >= 0]


def counted(docs: DataFrame, wanted: DataFrame, longest: int = LONGEST, block: int = 1024) -> DataFrame:
    """key, n: how often each phrase of ``wanted`` (size, key) occurs in ``docs``; its keys go to all tasks.

    A task counts by the place of a key; its counts leave in blocks, and equal blocks of all tasks are added up.
    """
    table = wanted.select("size", "key").toArrow()
    size, key = table["size"].to_numpy(), unsigned(table["key"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast([np.sort(key[size == m]) for m in range(1, longest + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Lookup(k) for k in shared.value]
        counts = [np.zeros(len(k), np.int64) for k in shared.value]
        for batch in batches:
            number, names = _languages(batch["lang"])
            for found in words(batch["text"], number, language_salts(names)):
                before = None
                for m in range(1, longest + 1):
                    before, place = _hits(found, m, before, lambda m, k: tables[m - 1].find(k))
                    if not len(before):
                        break
                    place, n = np.unique(place, return_counts=True)
                    counts[m - 1][place] += n
        for m, of in enumerate(counts, 1):
            starts = [k for k in range(0, len(of), block) if of[k:k + block].any()]
            yield pa.record_batch([pa.array(np.full(len(starts), m, np.int8)), pa.array(np.array(starts, np.int64)),
                                   pa.array([of[k:k + block] for k in starts], pa.list_(pa.int64()))], names=["size", "block", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        keys = lambda: pa.record_batch([pa.array(signed(shared.value[now[0] - 1][now[1]:now[1] + block])), pa.array(total)], names=["key", "n"])
        for batch in batches:
            for i, at in enumerate(zip(batch["size"].to_pylist(), batch["block"].to_pylist())):
                if at != now and now:
                    yield keys()
                total = batch["n"][i].values.to_numpy() + (total if at == now else 0)
                now = at
        if now:
            yield keys()

    parts = docs.mapInArrow(run, "size byte, block long, n array<long>")
    return parts.repartition("size", "block").sortWithinPartitions("size", "block").mapInArrow(added, "key long, n long")


def joined(docs: DataFrame, wanted: DataFrame, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """What counted() gives, for any number of phrases: counts of windows meet the wanted keys in a shuffle.

    A bitmap of 2 ** ``bits`` marks goes to the tasks; windows without a mark are not wanted and stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_marks(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _marked(shared.value)
        for batch in batches:
            number, names = _languages(batch["lang"])
            for found in words(batch["text"], number, language_salts(names)):
                before = None
                for m in range(1, longest + 1):
                    before, _ = _hits(found, m, before, marked)
                    if not len(before):
                        break
                    keys, n = np.unique(_keys(found.key, before, m), return_counts=True)
                    yield pa.record_batch([pa.array(signed(keys)), pa.array(n)], names=["key", "n"])

    every = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return every.join(wanted.select("key"), "key", "left_semi")


def frequent(docs: DataFrame, totals: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard: int = SHARD,
             travel: int = TRAVEL, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, n of every phrase of up to ``longest`` words that occurs ``support`` times in its language.

    ``docs`` as texts_of() gives them, ``totals`` as word_counts() does.
    """
    words_in_all = sum(r.n for r in totals.collect())
    if support * shard < least * words_in_all:
        found = stored(in_levels(docs, words_in_all, support, longest, shard), "counts")
    else:
        local = stored(mined(docs, totals, support, longest, shard), "local")
        wanted = stored(candidates(local, support), "candidates")
        counts = counted(docs, wanted, longest) if wanted.count() <= travel else joined(docs, wanted, longest)
        found = stored(wanted.join(counts.where(F.col("n") >= support), "key"), "counts")
    spelt = found.where("size = 1").select(F.col("key").alias("part"), F.col("text").alias("word"))
    return (found.select("lang", "key", "size", "n", F.posexplode("parts").alias("at", "part")).join(spelt, "part")
            .groupBy("lang", "key", "size", "n").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
            .select("lang", F.array_join("w.word", " ").alias("phrase"), "size", "n"))


def scored(phrases: DataFrame, totals: DataFrame, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``first`` phrases of each language.

    phrases: lang, phrase, size, n, with every phrase all its parts. A phrase of a words cut into parts that occur l and
    r times scores floor(1000 * a * n / (l * r)), in decimals of 38 digits (counts up to 10^15); the lowest cut counts,
    of equal ones the first. Phrases inside a longer one that occurs ``covered`` percent as often are left out. It is
    enough to look at those one word longer: the ones between are at least as frequent.
    """
    parts = phrases.select("lang", "size", F.col("n").alias("a"), "phrase", F.split("phrase", " ", -1).alias("w")).where("size > 1")
    text = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    cuts = (parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)))
            .select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"),
                    text(F.col("k") + 1, F.col("size").cast("int") - F.col("k")).alias("right")))
    count_of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"]).join(totals, "lang")
    digits = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"({digits('a')} * {digits('n')} * 1000) div ({digits('l')} * {digits('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.explode(F.array(text(F.lit(1), F.col("size").cast("int") - 1), text(F.lit(2), F.col("size").cast("int") - 1)))
    longer = parts.where("size > 2").select("lang", "a", shorter.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
            .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, covered: int = COVERED, first: int = FIRST,
                 shard: int = SHARD, travel: int = TRAVEL, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``first`` phrases of each language of ``docs`` (text, lang).

    A-Z are lowered; texts fall into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs. Phrases
    are 2 to ``longest`` words of a piece that occur ``support`` times in the texts of their language, overlaps
    included. A null language is ``und``; null and empty texts have no words; rows that repeat count as often as they
    are there. An empty table gives no rows.
    """
    docs = texts_of(docs)
    totals = stored(word_counts(docs), "totals")
    return scored(stored(frequent(docs, totals, support, longest, shard, travel, least), "frequent"), totals, covered, first)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents"))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
phrases AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*)::HUGEINT AS a
    FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)
    GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM phrases WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM split),
cut_scores AS (
    SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000 * c.a * t.n) // (x.a * y.a) AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT s.lang, array_to_string(s.w[j:j + n - 1], ' ') AS phrase, max(s.a) AS a
    FROM split s, (SELECT unnest([1, 2, 3, 4]) AS j), (SELECT unnest([2, 3, 4]) AS n)
    WHERE n < s.m AND j + n - 1 <= s.m GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase,
       b.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, b.n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
WHERE longer.a IS NULL OR 100 * longer.a < 100 * b.a
QUALIFY rank <= 2000
"""
