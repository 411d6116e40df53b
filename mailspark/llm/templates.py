"""Benchmark decontamination by templates: numbers with their units, names and sentence starts become typed slots, windows
of template tokens are joined by hash, and a name of the item has to stand for one name in the document.

So a question asked again with other numbers and names is found, and a short text that only has the same phrase
pattern, with names that do not correspond, is not. What is copied word for word is found whatever its slots hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read, stored
from mailspark.llm.words import _Tables, Chunk, Lookup, chunks, mixed, signed, span_keys, unsigned, window_keys

#: Tokens of a window; a shorter item is one window.
WINDOW = 8
#: A window with slots has so many tokens that are no slots; it is longer than WINDOW where it needs to be.
LEAST_LITERALS = 4
#: A leak covers so many tokens of an item, or the whole item.
COVER = 12
#: Where names contradict each other, tokens beside them count as a leak from so many times COVER on.
AGAINST_NAMES = 2
#: Windows of the benchmark that may travel to every task (8 bytes each); more are joined in the shuffle alone.
TRAVEL = 1 << 21

# fixed values
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres kilometer kilometers
mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon
gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years cent
cents dollar dollars euro euros usd eur percent degree degrees mph kmh w kw v hz""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_JOINT = np.zeros(256, bool)
_JOINT[list(b".,:/")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_GAP = np.zeros(256, bool)
_GAP[list(b" \t\r\n-'")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LITERAL, NUMBER, UNIT, NAME, FIRST = range(5)
TYPED, PLAIN = range(2)
_SLOT_KEYS = mixed(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x3C6EF372FE94F82B))


def _keys_of(words: list[str]) -> np.ndarray:
    return np.sort(next(chunks(pa.array([" ".join(words)]))).key)


_UNIT_KEYS, _NUMBER_KEYS = _keys_of(UNITS), _keys_of(NUMBER_WORDS)


def _without_blanks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where code points of scripts without blanks begin (Thai, Lao, Burmese, Khmer, kana, ideographs), where they end,
    and which bytes are signs of these scripts."""
    a, b, c = data, np.append(data[1:], 0)[:len(data)], np.append(data[2:], [0, 0])[:len(data)]
    within = lambda x, low, high: (x >= low) & (x <= high)
    three = (((a == 0xE0) & within(b, 0xB8, 0xBB)) | ((a == 0xE1) & (within(b, 0x80, 0x81) | ((b == 0x82) & (c < 0xA0)) | within(b, 0x9E, 0x9F)))
             | ((a == 0xE3) & (within(b, 0x81, 0x83) | (b >= 0x90))) | within(a, 0xE4, 0xE9) | ((a == 0xEF) & within(b, 0xA4, 0xAB)))
    four = (a == 0xF0) & (b >= 0xA0)
    last = np.zeros(len(data), bool)
    last[2:] |= three[:-2]
    last[3:] |= four[:-3]
    sign = ((a == 0xE3) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBC) & (within(c, 0x81, 0x8F) | within(c, 0x9A, 0xA0)))
    whole = sign.copy()
    whole[1:] |= sign[:-1]
    whole[2:] |= sign[:-2]
    return three | four, last, whole


class Template:
    """Tokens of a chunk's texts, and units: a token, or a run of tokens that is one slot.

    A run of numbers and the unit behind it is one NUMBER, a run of names one NAME, and a sentence start with the
    names behind it one FIRST; nothing but blanks, hyphens and apostrophes lies inside.
    """

    def __init__(self, chunk: Chunk):
        data, at = chunk.data, chunk.text_at
        lead = np.zeros(len(data) + 1, bool)
        lead[at[:-1]] = True  # where a text begins
        digit = _DIGIT[data]
        inside = _WORD[data]
        inside[1:-1] |= _JOINT[data[1:-1]] & digit[:-2] & digit[2:] & ~lead[1:-2] & ~lead[2:-1]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | lead[1:-1]
        ends[:-1] &= ~inside[1:] | lead[1:-1]
        if len(data) and data.max() >= 0xE0:
            alone, last, sign = _without_blanks(data)
            inside &= ~sign
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1] | lead[1:-1] | alone[1:] | last[:-1]
            ends[:-1] &= ~inside[1:] | lead[1:-1] | alone[1:] | last[:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.rows, self.at = chunk.rows, np.searchsorted(start, at)
        self.row = np.repeat(np.arange(chunk.rows), np.diff(self.at))
        latin = np.zeros(len(data) + 1, bool)  # second bytes of the capitals U+00C0 to U+00DE
        latin[1:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lowered = _LOWER[data]
        lowered[latin[:-1]] += 32
        self.value = span_keys(lowered, start, end)
        digits, stops, breaks = (np.concatenate([[0], np.cumsum(m)]) for m in (digit, _STOP[data], ~_GAP[data]))
        n = len(start)
        first = np.ones(n, bool)
        first[1:] = (self.row[1:] != self.row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
        near = np.zeros(n, bool)  # only a gap lies between the token and the one before
        near[1:] = (self.row[1:] == self.row[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
        number = (digits[end] > digits[start]) | np.isin(self.value, _NUMBER_KEYS)
        unit = np.zeros(n, bool)
        unit[1:] = np.isin(self.value[1:], _UNIT_KEYS) & number[:-1] & near[1:] & ~number[1:]
        upper = np.append(_UPPER[data] | latin[1:], False)
        second = start + np.where(_UPPER[data[start]], 1, 2)
        capital = upper[start] & ~(upper[np.minimum(second, len(data))] & (second < end))  # not those in capitals throughout
        kind = np.select([number, unit, capital & first, capital], [NUMBER, UNIT, FIRST, NAME], LITERAL).astype(np.int8)
        joins = unit.copy()
        joins[1:] |= near[1:] & (((kind[1:] == NUMBER) & (kind[:-1] == NUMBER))
                                 | ((kind[1:] == NAME) & ((kind[:-1] == NAME) | (kind[:-1] == FIRST))))
        head = np.flatnonzero(~joins)
        self.unit_at = np.searchsorted(head, self.at)
        self.unit_row, self.size = self.row[head], np.diff(np.append(head, n))
        self.kind = kind[head]
        place = (np.arange(n) - np.repeat(head, self.size)).astype(np.uint64)
        with np.errstate(over="ignore"):
            parts = mixed(self.value + place * np.uint64(0x9E3779B97F4A7C15))
            self.unit_value = mixed(np.add.reduceat(parts, head)) if len(head) else np.zeros(0, np.uint64)
        self.unit_key = np.where(self.kind == LITERAL, self.unit_value, _SLOT_KEYS[self.kind])
        with np.errstate(over="ignore"):
            in_text = mixed(self.unit_value + self.unit_row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        named = np.isin(in_text, in_text[self.kind == NAME])
        self.is_name = (self.kind == NAME) | ((self.kind == FIRST) & named)  # a sentence start that is a name elsewhere

    def plain(self, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Position and key of windows of ``size`` tokens as they are; whole: only texts that have this size."""
        at = _starts(self.at, size, whole)
        return at, window_keys(mixed(self.value), size)[at] if len(at) else np.zeros(0, np.uint64)

    def typed(self, window: int, sizes: list[int], longest: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, size and key of windows of units with slots as such, LEAST_LITERALS literals or more in each.

        A window of ``window`` units that has fewer is longer, to the right and to the left, up to ``longest``. ``sizes``
        are smaller ones for short texts; whole: only those of texts of that size.
        """
        n = len(self.unit_key)
        literals = np.flatnonzero(self.kind == LITERAL)
        before = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        last, begin = (np.repeat(x, np.diff(self.unit_at)) for x in (self.unit_at[1:], self.unit_at[:-1]))
        found = []
        for size in sizes:
            at = _starts(self.unit_at, size, whole)
            found.append((at[before[at + size] - before[at] >= LEAST_LITERALS], size))
        at = np.arange(n)
        far = np.append(literals, np.full(LEAST_LITERALS, n + longest + 1))[before[at] + LEAST_LITERALS - 1] + 1
        size = np.maximum(window, far - at)
        found.append(((ok := np.flatnonzero((at + size <= last) & (size <= longest))), size[ok]))
        end = at + 1
        far = np.concatenate([np.full(LEAST_LITERALS, -longest - 1), literals])[before[end]]  # the last but LEAST_LITERALS - 1
        size = end - far
        ok = np.flatnonzero((size > window) & (far >= begin) & (size <= longest))
        found.append((far[ok], size[ok]))
        at = np.concatenate([f[0] for f in found]).astype(np.int64)
        size = np.concatenate([np.broadcast_to(f[1], len(f[0])) for f in found]).astype(np.int64)
        _, only = np.unique(at * (longest + window + 1) + size, return_index=True)
        at, size = at[only], size[only]
        power, inverse = _Tables.upto(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.unit_key) * power[:n])])
            key = mixed(mixed((sums[at + size] - sums[at]) * inverse[at]) ^ (size.astype(np.uint64) << np.uint64(8)) ^ np.uint64(TYPED + 1))
        return at, size, key


def _starts(bounds: np.ndarray, size: int, whole: bool) -> np.ndarray:
    """Where windows of ``size`` entries begin in texts that begin at ``bounds``; whole: only texts of that size."""
    counts = np.diff(bounds)
    if whole:
        return bounds[:-1][counts == size]
    at = np.arange(bounds[-1])
    return at[at + size <= np.repeat(bounds[1:], counts)]


ROW = "_row"
NAMES = ["key", "row", "id", "form", "pos", "tokens", "values", "kinds", "sizes"]
SCHEMA = ("key long, row long, id long, form int, pos long, tokens long, values array<long>, kinds array<int>, "
          "sizes array<int>")
#: What an entry of ``kinds`` may be.
AS_IT_IS, SLOT, NAME_SLOT = range(3)


def _batch(owner: tuple[pa.Array, pa.Array], template: Template, form: int, at: np.ndarray, size: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    bounds, row_of = (template.at, template.row) if form == PLAIN else (template.unit_at, template.unit_row)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    cell = np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])
    if form == PLAIN:
        value, kind, tokens = template.value[cell], np.zeros(len(cell), np.int32), np.ones(len(cell), np.int32)
    else:
        value, tokens = template.unit_value[cell], template.size[cell].astype(np.int32)
        kind = np.where(template.kind == LITERAL, AS_IT_IS, np.where(template.is_name, NAME_SLOT, SLOT))[cell].astype(np.int32)
    row = row_of[at] if len(at) else np.zeros(0, np.int64)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
    return pa.record_batch([
        pa.array(signed(key)), *(o.take(pa.array(row)) for o in owner), pa.array(np.full(len(at), form, np.int32)),
        pa.array((at - bounds[row]).astype(np.int64)), pa.array(np.diff(template.at)[row].astype(np.int64)),
        listed(signed(value)), listed(kind), listed(tokens)], names=NAMES)


def row_key(name: str) -> Column:
    """Tells rows apart that repeat an id, or have none."""
    return F.xxhash64(F.col(name).cast("long"), F.col("text"))


def _windows(rows: DataFrame, name: str, plain: list[int], typed: list[int], window: int, longest: int | None,
             whole: bool, wanted: Broadcast | None = None) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"], keys=False):
                template = Template(chunk)
                owner = tuple(batch[c].slice(chunk.first, chunk.rows) for c in (ROW, name))
                most = len(template.unit_key) if longest is None else longest
                for form, (at, size, key) in [
                        *((PLAIN, (at, np.full(len(at), n), key)) for n in plain for at, key in [template.plain(n, whole and n < window)]),
                        (TYPED, template.typed(window, typed, most, whole))]:
                    if wanted is not None:
                        hit = np.flatnonzero(wanted.value.find(key) >= 0)
                        at, size, key = at[hit], size[hit], key[hit]
                    for k in range(0, len(at), 1 << 14):
                        part = slice(k, k + (1 << 14))
                        yield _batch(owner, template, form, at[part], size[part], key[part])

    return rows.where("text IS NOT NULL").select(row_key(name).alias(ROW), F.col(name).cast("long"), "text").mapInArrow(run, SCHEMA)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, item, item_id, form, ipos, item_tokens, ivalues, ikinds, isizes: all windows of ``items`` (item_id, text).

    Positions and entries are tokens in the plain form and units in the typed one.
    """
    sizes = list(range(1, window))
    found = _windows(items, "item_id", [*sizes, window], sizes, window, None, True)
    return found.toDF("key", "item", "item_id", "form", "ipos", "item_tokens", "ivalues", "ikinds", "isizes")


def document_windows(docs: DataFrame, plain: list[int], typed: list[int], window: int, longest: int, wanted: Broadcast | None) -> DataFrame:
    """key, doc, doc_id, form, dpos, dvalues: windows of ``docs`` (doc_id, text) whose keys are wanted, or all windows."""
    found = _windows(docs, "doc_id", plain, typed, window, longest, False, wanted)
    return found.select("key", F.col("row").alias("doc"), F.col("id").alias("doc_id"), "form", F.col("pos").alias("dpos"), F.col("values").alias("dvalues"))


def row_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = COVER, travel: int = TRAVEL) -> DataFrame:
    """doc, doc_id, item, item_id, covered, item_tokens, slots, changed, kind: the items that documents hold.

    doc and item are row_key(): rows that repeat an id, or have none, are read one by one.

    Windows of one form with equal keys on one diagonal (place in the document less place in the item) belong
    together. They are a leak when they cover ``cover`` tokens of the item, or all of a shorter one. Plain windows,
    with all tokens as they are (A-Z lowered), need nothing else. In typed windows every name of the item has to
    stand for one name of the document; where one stands for several, the places that differ from its most frequent
    one are dropped, and AGAINST_NAMES times ``cover`` other tokens are a leak. Numbers may be equal by chance, and
    sentence starts are names only if the item has them as names elsewhere. kind: ``exact`` if no slot has another
    value, else ``reparameterised``. Of several leaks of an item in one row the one that covers most is given.

    A text of fewer than ``window`` tokens is one plain window; in scripts without blanks a code point is a token.
    Null and empty texts hold nothing. Equal rows are one.
    """
    known = stored(item_windows(items, window), "item-windows")
    sizes = known.select("form", F.size("ivalues").alias("n")).distinct().collect()
    plain = sorted(r.n for r in sizes if r.form == PLAIN)
    typed = sorted(r.n for r in sizes if r.form == TYPED)
    wanted = None
    if known.count() <= travel:
        keys = np.unique(unsigned(known.select("key").toArrow()["key"].to_numpy()))
        wanted = docs.sparkSession.sparkContext.broadcast(Lookup(keys))
    found = document_windows(docs, plain, [n for n in typed if n < window], window, max(typed, default=0), wanted)
    hits = found.join(known, ["key", "form"])
    cells = F.arrays_zip(F.sequence(F.col("ipos"), F.col("ipos") + F.size("ivalues") - 1).alias("place"),
                         F.col("ivalues").alias("mine"), F.col("dvalues").alias("theirs"), F.col("ikinds").alias("kind"),
                         F.col("isizes").alias("size"))
    whose = ["doc", "doc_id", "item", "item_id"]
    diagonal = [*whose, "form", "diagonal"]
    tokens = hits.select(*whose, "form", (F.col("dpos") - F.col("ipos")).alias("diagonal"), "item_tokens",
                         F.explode(cells).alias("t")).select(*diagonal, "item_tokens", "t.*")
    per_place = tokens.groupBy(*diagonal, "place").agg(
        F.max("item_tokens").alias("item_tokens"), F.max("kind").alias("kind"), F.first("mine").alias("mine"),
        F.first("theirs").alias("theirs"), F.max("size").alias("size"))
    slot, name = F.col("kind") != AS_IT_IS, F.col("kind") == NAME_SLOT
    # names of the item with what stands for them; all other places of a diagonal are one row
    pairs = per_place.groupBy(*diagonal, F.when(name, F.col("mine")).alias("name"), F.when(name, F.col("theirs")).alias("other")).agg(
        F.max("item_tokens").alias("item_tokens"), F.sum("size").alias("size"), F.count(F.when(slot, 1)).alias("slots"),
        F.count(F.when(slot & (F.col("mine") != F.col("theirs")), 1)).alias("changed"))
    names = pairs.groupBy(*diagonal, "name").agg(
        F.max("item_tokens").alias("item_tokens"), F.sum("size").alias("size"), F.max("size").alias("most"),
        F.sum("slots").alias("slots"), F.sum("changed").alias("changed"))
    runs = names.groupBy(*diagonal).agg(
        F.max("item_tokens").alias("item_tokens"), F.sum("size").alias("covered"), F.sum("most").alias("agreeing"),
        F.sum("slots").alias("slots"), F.sum("changed").alias("changed"))
    enough = F.least(F.lit(cover), F.col("item_tokens"))
    runs = runs.where(F.when(F.col("agreeing") == F.col("covered"), F.col("covered") >= enough)
                      .otherwise(F.col("agreeing") >= AGAINST_NAMES * cover))
    return _best(runs, whose)


def _best(found: DataFrame, whose: list[str]) -> DataFrame:
    best = found.groupBy(*whose).agg(F.max(F.struct(
        "covered", (-F.col("changed")).alias("c"), "item_tokens", "slots", "changed")).alias("b"))
    kind = F.when(F.col("b.changed") == 0, F.lit("exact")).otherwise(F.lit("reparameterised"))
    return best.select(*whose, "b.covered", "b.item_tokens", "b.slots", "b.changed", kind.alias("kind"))


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """row_leaks() by id: of the rows of a document, and of an item, the pair that covers most. A null doc_id is one."""
    return _best(row_leaks(docs, items, **options), ["doc_id", "item_id"])


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns; rows that repeat an id, or have none, one by one."""
    held = row_leaks(docs, items, **options).select(F.col("doc").alias("_held")).distinct()
    return docs.join(held, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == held["_held"], "left_anti")


def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
