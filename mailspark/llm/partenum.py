"""Similarity join of word-shingle sets by signatures of single parts, exact for every threshold.

Two sets of about equal size whose Jaccard similarity reaches the threshold differ in few elements only. The feature
domain is cut into parts; with more parts than there can be differences, some parts are equal, and sets that share
enough signatures (equal parts) are compared. This is partition-and-enumerate in its degenerate form, plain pigeonhole
partitioning: there is no second level, and no subsets of parts are enumerated. What a single part lacks in selectivity
is made up for by numbers: there are more parts than needed, so linked sets share several.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailspark.llm.graph import components
from mailspark.llm.tables import read, stored
from mailspark.llm.words import Chunk, chunks, lists, mixed, signed, unsigned, window_keys

#: Bytes of text that are taken at a time: what is made of them stays in a core's cache.
CHUNK = 1 << 16
#: Sizes of one band differ by this factor at most.
BAND = 1.5
#: Parts beyond those that must be there, for each of the elements in which linked sets may differ.
MORE = 0.15
#: Groups of so many sets that share a signature are compared pair by pair.
FEW = 8
#: Groups of sets that share an element are compared with one member first if they have more pairs than half of this for each.
LARGE = 1024
_ROW = np.uint64(0xA24BAED4963EE407)
_PART, _SUM, _SIGN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(0x9B05688C2B3E6C1F)


class Bands:
    """Bands of set sizes, and how many parts sets of a band are cut into.

    Sets of a band of sizes up to r that reach ``percent`` differ in k elements at most. Of n > k parts at least n - k
    are equal, and each part alone is signed. ``spare`` is n - k - 1: as many parts may be empty in a set without being
    signed, as one more part that is not empty is then equal. Only a set with more empty parts signs these, too.
    So a set with e empty parts shares spare + 1 - e signatures of the band at least with each set that it is linked
    with (one, if it signs empty parts), the band being that of the larger one.
    """

    def __init__(self, percent: int, largest: int):
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * BAND)))
        self.low = np.array(self.low)
        self.parts, self.spare = np.ones(len(self.low), np.int64), np.zeros(len(self.low), np.int64)
        for i, (low, high) in enumerate(zip(self.low[:-1], self.low[1:] - 1)):
            k = (100 - percent) * 2 * int(high) // (100 + percent)
            if not k:
                continue
            parts = k + 1
            for _ in range(3):
                empty = parts * math.exp(-low / parts)
                parts = min(2 * (k + 1), k + 1 + max(0, math.ceil(empty + 2 * math.sqrt(empty) - 0.5)) + math.ceil(MORE * k))
            self.parts[i] = 2 * ((parts + 1) // 2)
            self.spare[i] = self.parts[i] - k - 1


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the distinct n-word shingles of a chunk's texts, sorted by row and key. A text of fewer words
    has its whole sequence as one."""
    counts = chunk.counts()
    row_of, at = chunk.row_of_word(), chunk.window_starts(n)
    rows, keys = [row_of[at]], [window_keys(chunk.key, n)[at]] if len(at) else [np.zeros(0, np.uint64)]
    for words in range(1, n):
        short = np.flatnonzero(counts == words)
        if len(short):
            rows.append(short)
            keys.append(window_keys(chunk.key, words)[chunk.word_at[short]])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[first], key[first]


def _set_keys(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, row, mixed(key))
    return out


def _signatures(row: np.ndarray, key: np.ndarray, size: np.ndarray, band: np.ndarray, bands: Bands, which: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and signature, by row, of the sets of the rows ``which`` as members of the given band of each; how many of
    them each row shares with whatever it is linked with."""
    parts = np.where(which, bands.parts[band], 0)
    at = np.concatenate([[0], np.cumsum(parts)])
    mine = which[row]
    row, key = row[mine], key[mine]
    slot = at[row] + (mixed(key ^ _PART) % parts[row].astype(np.uint64)).astype(np.int64)
    sums, filled = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool)
    with np.errstate(over="ignore"):
        np.add.at(sums, slot, mixed(key ^ _SUM))
        filled[slot] = True
        owner = np.repeat(np.arange(len(size)), parts)
        label = (np.arange(at[-1]) - at[owner]).astype(np.uint64) * np.uint64(4096) + band[owner].astype(np.uint64)
        sign = mixed(sums + mixed(label ^ _SIGN))
    empty = np.bincount(owner[~filled], minlength=len(size))
    signed_ = filled | (empty > bands.spare[band])[owner]
    return owner[signed_], sign[signed_], np.maximum(bands.spare[band] - empty, 0) + 1


def set_keys(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, f (a 64-bit key of the set, null for an empty one) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"], lower=True, size=CHUNK):
                row, key = shingle_sets(chunk, n)
                size = np.bincount(row, minlength=chunk.rows)
                yield pa.record_batch([
                    batch["doc_id"].slice(chunk.first, chunk.rows), pa.array(size),
                    pa.array(signed(_set_keys(row, key, chunk.rows)), mask=size == 0)], names=["doc_id", "n_shingles", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, f long")


def signed_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, f (as in set_keys()), bands (band, need, signs) of every row of ``docs``.

    A set signs its own band, and every higher one of which a set can reach the threshold with it. It shares ``need``
    of a band's signatures at least with any set of this band that it is linked with and that is not smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, 1 << 16)
        for batch in batches:
            for chunk in chunks(batch["text"], lower=True, size=CHUNK):
                row, key = shingle_sets(chunk, n)
                size = np.bincount(row, minlength=chunk.rows)
                if len(size) and size.max() >= bands.low[-1]:
                    bands = Bands(percent, int(size.max()) * 2)
                band = np.maximum(np.searchsorted(bands.low, size, "right") - 1, 0)
                found, upper, near = [(np.zeros(0, np.int64),) * 6], band, size > 0
                while near.any():
                    rows, signs, need = _signatures(row, key, size, upper, bands, near)
                    mine = np.flatnonzero(near)
                    found.append((rows, signs.view(np.int64), mine, upper[mine], need[mine], np.bincount(rows, minlength=chunk.rows)[mine]))
                    last, upper = upper, np.minimum(upper + 1, len(bands.low) - 1)
                    near = near & (upper > last) & (100 * size >= percent * bands.low[upper])
                rows, signs, mine, which, need, counts = map(np.concatenate, zip(*found))
                order = np.argsort(mine, kind="stable")
                entries = pa.StructArray.from_arrays([
                    pa.array(which[order].astype(np.int32)), pa.array(need[order].astype(np.int32)),
                    lists(signs[np.argsort(rows, kind="stable")], counts[order])], ["band", "need", "signs"])
                at = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=chunk.rows))]).astype(np.int32)
                yield pa.record_batch([
                    batch["doc_id"].slice(chunk.first, chunk.rows),
                    pa.array(signed(_set_keys(row, key, chunk.rows)), mask=size == 0),
                    pa.ListArray.from_arrays(pa.array(at), entries)], names=["doc_id", "f", "bands"])

    schema = "doc_id long, f long, bands array<struct<band int, need int, signs array<long>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """f, elements: one sorted set for each f of ``texts`` (f, text); texts whose set is another one are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = unsigned(batch["f"].to_numpy())
            for chunk in chunks(batch["text"], lower=True, size=CHUNK):
                row, key = shingle_sets(chunk, n)
                right = _set_keys(row, key, chunk.rows) == wanted[chunk.first:chunk.first + chunk.rows]
                sizes = np.where(right, np.bincount(row, minlength=chunk.rows), 0)
                at = np.concatenate([[0], np.cumsum(sizes[right])]).astype(np.int32)
                yield pa.record_batch([
                    pa.array(signed(wanted[chunk.first:chunk.first + chunk.rows][right])),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(signed(key[right[row]])))], names=["f", "elements"])

    return texts.select("f", "text").mapInArrow(run, "f long, elements array<long>").dropDuplicates(["f"])


def _rare_first(sets: DataFrame, some: DataFrame) -> DataFrame:
    """``sets`` (f, elements), those of ``some`` (f) with their elements by (number of these sets that hold it, element)."""
    rows = sets.join(some, "f").select("f", F.explode("elements").alias("e"))
    rows = rows.join(rows.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e")
    ordered = rows.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("n", "e")))["e"].alias("elements"))
    return ordered.unionByName(sets.join(some, "f", "left_anti"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """linked, size, apart, prefix for each pair (p, x, many), both keys of sets.

    Let D(x) be the symmetric difference of x and p, and d its size. Sets x and y of p's group that are linked, of
    which one is not linked with p, have an element of D(x) and D(y) in common: d(x) + d(y) exceeds what x and y may
    differ in, as a set's size differs from p's by d at most. The common elements are d(x) - K(x) at least, with K(x)
    what x can differ in from any set it is linked with; so under one order of elements the first K(x) + 1 of each
    hold one. ``prefix`` holds these where ``many``. Elements that p has not come first, the rarest of them first (the
    sets being ordered by _rare_first()), so that a set with more than K(x) elements of its own meets no other; then
    come those that only p has, the most frequent first, which the fewest others are without.
    """
    of_x = sets.select(F.col("f").alias("x"), F.col("elements").alias("xs"))
    of_p = sets.select(F.col("f").alias("p"), F.col("elements").alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, apart, prefixes = [], [], []
            xs, ps, many = batch["xs"], batch["ps"], batch["many"].to_pylist()
            for k in range(len(batch)):
                x, p = xs[k].values.to_numpy(), ps[k].values.to_numpy()
                by_value = np.sort(p)
                common = by_value[np.minimum(np.searchsorted(by_value, x), len(p) - 1)] == x
                both = int(common.sum())
                d = len(x) + len(p) - 2 * both
                linked.append(100 * both >= percent * (len(x) + len(p) - both))
                apart.append(d)
                prefix = np.zeros(0, np.int64)
                if many[k]:
                    fresh, gone = x[~common], p[~np.isin(p, x, assume_unique=True)]
                    least = max(1, d - len(x) * (100 - percent) // percent)
                    prefix = np.concatenate([fresh, gone[::-1]])[:d - least + 1]
                prefixes.append(prefix)
            at = np.concatenate([[0], np.cumsum([len(v) for v in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.record_batch([
                batch["p"], batch["x"], pa.array(linked, pa.bool_()), batch["size"], pa.array(apart, pa.int32()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["p", "x", "linked", "size", "apart", "prefix"])

    rows = pairs.join(of_x, "x").join(of_p, "p").select("p", "x", "many", "xs", "ps", F.size("xs").alias("size"))
    return rows.mapInArrow(run, "p long, x long, linked boolean, size int, apart int, prefix array<long>")


def _shared(found: DataFrame) -> DataFrame:
    """sign, x, band, need: the signatures that different sets share, of sets that share as many as a link needs.

    A set whose shared signatures of a band are fewer than its ``need`` is linked with none there and goes.
    """
    by_sign = Window.partitionBy("sign")
    rows = found.select(F.col("f").alias("x"), F.inline("bands")).select(F.explode("signs").alias("sign"), "x", "band", "need")
    rows = rows.withColumns({"low": F.min("x").over(by_sign), "high": F.max("x").over(by_sign)}).where("low < high")
    rows = stored(rows.select("sign", "x", "band", "need").distinct(), "groups")  # rows with equal sets are one
    enough = rows.groupBy("x", "band").agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("need")).where("has >= need")
    return rows.join(enough.select("x", "band"), ["x", "band"])


def _first_pairs(found: DataFrame) -> DataFrame:
    """p, x, many: what to compare of sets that share signatures: pairs of a group of FEW sets at most, and one set of
    a larger group with all others (``many``: the others among each other are still to come).

    Pairs of small groups have to share enough signatures, all those in larger groups given them for free. The one
    set of a larger group is the set that stands in most of them: the text that the others were made from, if there
    is one, shares signatures with all of them.
    """
    rows = _shared(found).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sign")))
    rows = stored(rows.withColumn("free", F.count_if(F.col("n") > FEW).over(Window.partitionBy("x", "band"))), "groups")
    small = rows.where(F.col("n") <= FEW).drop("n")
    other = small.select("sign", F.col("x").alias("p"), F.col("need").alias("need_p"), F.col("free").alias("free_p"))
    pairs = small.join(other, "sign").where("p < x").groupBy("p", "x", "band").agg(
        (F.count(F.lit(1)) + F.least(F.max("free"), F.max("free_p"))).alias("has"),
        F.greatest(F.max("need"), F.max("need_p")).alias("need")).where("has >= need").select("p", "x", F.lit(False).alias("many"))
    large = rows.where(F.col("n") > FEW).select("sign", "x")
    weight = large.groupBy("x").agg(F.count(F.lit(1)).alias("groups"))
    heads = large.join(weight, "x").groupBy("sign").agg(F.max(F.struct("groups", "x"))["x"].alias("p"))
    large = large.join(heads, "sign").where("x <> p").select("p", "x", F.lit(True).alias("many"))
    return pairs.unionByName(large).groupBy("p", "x").agg(F.max("many").alias("many"))


def _next_pairs(verdicts: DataFrame, roots: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """p, x, many: what to compare of sets that were compared with the same one, by elements in which both differ
    from it, and that no links connect yet (``roots``: node, root).

    D(x) and D(y) share t = (d(x) + d(y) - k) / 2 elements at least, k being what sets of their sizes may differ in.
    Their first common one stands at i in D(x) and j in D(y), and no more than min(d(x) - i, d(y) - j) can follow from
    there; so i is (d(x) - d(y) + K(x)) / 2 at most. Of a group the sets outside its largest component are compared with all others. Where these are too many,
    for more than LARGE / 2 pairs a set, one set is compared with all others instead, and its group goes on: of the
    largest component the one that differs least from the set before. It has never been such a set (``hubs``: p), so
    groups are not passed on in a circle; a group of former ones only is compared pair by pair.
    """
    by = ["of", "e"]
    rows = verdicts.join(roots.withColumnRenamed("node", "x"), "x", "left").join(
        hubs.select(F.col("p").alias("x"), F.lit(True).alias("was")), "x", "left").select(
        "x", F.coalesce("root", "x").alias("root"), F.col("was").isNull().alias("new"), F.col("p").alias("of"), "size", "apart",
        F.posexplode("prefix").alias("at", "e"))
    first = lambda order: F.min(F.when(F.col("new"), F.struct(*order)))
    parts = rows.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("low"), first(["apart", "x"]).alias("best"))
    groups = parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("components"), F.min("low").alias("low"),
        F.max(F.struct("n", "root")).alias("most"), F.max(F.when(F.col("best").isNotNull(), F.struct("n", "root", "best"))).alias("next"))
    large = (F.col("n") * F.col("n") - F.col("squares") > LARGE * F.col("n")) & F.col("next").isNotNull()
    groups = groups.where("components > 1").select(
        *by, "low", F.col("most.root").alias("main"), F.when(large, F.col("next.best.x")).alias("q"))
    own = F.floor(F.col("size") * (100 - percent) / percent)
    rows = stored(rows.drop("new").join(groups, by).where(F.col("q").isNotNull() | (2 * F.col("at") <= F.col("apart") - F.col("low") + own)), "groups")
    small = rows.where("q IS NULL")
    y = small.select(*by, *[F.col(c).alias(f"{c}_y") for c in ("x", "root", "size", "apart", "at")])
    may = F.floor((100 - percent) * (F.col("size") + F.col("size_y")) / (100 + percent))
    pairs = small.where("root <> main").join(y, by).where(
        (F.col("root") != F.col("root_y")) & ((F.col("root_y") == F.col("main")) | (F.col("x_y") < F.col("x")))
        & (100 * F.least("size", "size_y") >= percent * F.greatest("size", "size_y"))
        & (2 * F.least(F.col("apart") - F.col("at"), F.col("apart_y") - F.col("at_y")) >= F.col("apart") + F.col("apart_y") - may))
    pairs = pairs.select(F.least("x", "x_y").alias("p"), F.greatest("x", "x_y").alias("x"), F.lit(False).alias("many"))
    large = rows.where("x <> q").select(F.col("q").alias("p"), "x", F.lit(True).alias("many"))
    return pairs.unionByName(large).groupBy("p", "x").agg(F.max("many").alias("many"))


def connected(docs: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """node, root: the components() that all links between different sets make of set keys. ``found``: the set_keys()
    of ``docs``. Signatures are many times larger: they are shuffled as they are made, and not stored.

    Sets of one signature are compared with one of them only, but for small groups. What is not linked with that one
    is dealt into groups by the elements in which it differs from it; these groups are small and filtered by what
    their members can have in common, or dealt again in the same way. After each round only sets that links do not
    connect yet are compared. So no group is compared all against all because it is large, and no pair is passed over
    that would connect anything.
    """
    pairs = stored(_first_pairs(signed_sets(docs, n, percent)), "pairs")
    ends = lambda of: of.select(F.col("p").alias("f")).unionByName(of.select(F.col("x").alias("f"))).distinct()
    holders = found.join(ends(pairs), "f").groupBy("f").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(_sets(docs.join(holders, "doc_id").select("f", "text"), n), "sets")
    sets = stored(_rare_first(sets, ends(pairs.where("many"))), "sets")
    roots = hubs = None
    while roots is None or not pairs.isEmpty():
        verdicts = stored(_compared(pairs, sets, percent), "verdicts")
        links = verdicts.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
        roots = components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        used = pairs.where("many").select("p").distinct()
        hubs = stored(used if hubs is None else hubs.unionByName(used), "hubs")
        pairs = stored(_next_pairs(verdicts, roots, hubs, percent), "pairs")
    return roots


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    A row's set holds its distinct ``n``-word shingles (A-Z lowered; a text of fewer words is one shingle). Rows are
    linked when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that links reach.

    Null and empty texts have an empty set and are linked with nothing. Equal sets are one node, whatever the number
    of rows. Rows that repeat a doc_id may have different texts; they are rows of their own and meet in a component
    only through links. A row with a null doc_id is linked with nothing and keeps null.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = stored(set_keys(docs, n), "keys")
    roots = connected(docs.where("doc_id IS NOT NULL"), found.where("doc_id IS NOT NULL"), n, percent)
    rooted = found.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn(
        "root", F.coalesce("root", "f"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their columns: those with the component's doc_id.

    Rows that repeat a doc_id stay or go together, but of equal texts one stays. Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), 3, 90)
