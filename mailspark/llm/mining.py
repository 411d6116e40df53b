"""Hard-negative mining over an R-tree that is packed by sort-tile-recursive.

The tree's upper entries are tiles, cut from a bounded sample; every row goes to its tile, hot tiles in parts. Each part
is packed into leaves of consecutive rows of the recursive order, and each leaf keeps the least and largest value of
every coordinate. For a query q the inner product with any row of a box lies between the sums of the smaller and of the
larger of q * low and q * high, coordinate by coordinate. A queue opens the box with the highest upper end first and
leaves out boxes outside the query's windows of scores and those strictly worse than the k-th row found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailspark.llm.tables import read, stored

#: Rows whose coordinates set the cuts of the tiles, at most.
SAMPLE = 16_384
#: Rows of a part about, and of a leaf at most.
PART, LEAF = 4_096, 64
#: Tiles times coordinates, at most: boxes of all tiles are sent to the tasks (two numbers each).
BOXES = 1 << 18
#: Coordinates that tiles and leaves are cut by, at most.
SLICED = 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_QUERY = "id long, label long, q array<long>, lows array<long>, highs array<long>, kth_score array<long>, kth_id array<long>"
_ENTRY = f"tile int, part int, kind int, leaf int, {_QUERY}"
_FOUND = "anchor_id long, w int, score long, id long"


def _list(batch, name: str, i: int) -> np.ndarray:
    return batch[name][i].values.to_numpy()


def _matrix(batch, dims: int) -> np.ndarray:
    return batch["q"].flatten().to_numpy().reshape(-1, dims) if dims else np.zeros((len(batch), 0), np.int64)


def quantised(x: Column, scale: int = 256) -> Column:
    """floor(scale * component) of every component, as longs."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long"))


def vectors(table: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, q of the rows of ``table`` (vec_id, label, ``vector``) that take part.

    Rows with a null id, label or vector and those with a null or non-finite component take no part. vec_id is a key:
    of rows that share one the first by (label, components) counts. Shorter vectors are filled up with zeros. Scaled
    components must fit in 64 bits.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = (table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(vector).alias("x"))
            .where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~F.exists("x", bad))
            .select("vec_id", "label", quantised(F.col("x"), scale).alias("q")))
    rows = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"), "vectors")
    dims = rows.agg(F.max(F.size("q"))).first()[0] or 0
    missing = F.lit(dims) - F.size("q")
    return rows.withColumn("q", F.when(missing > 0, F.concat("q", F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(F.col("q")))


def slices(x: np.ndarray, pieces: int, coordinates: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive: positions of the rows of ``x`` in about ``pieces`` runs of equal size.

    Rows are sorted by the first coordinate and cut into slabs, about as many as the root of ``pieces`` for the
    coordinates that are left; each slab is cut by the next coordinate. Ties keep the order given.
    """
    def cut(at: np.ndarray, pieces: int, level: int) -> list[np.ndarray]:
        if pieces <= 1 or level == len(coordinates) or len(at) <= 1:
            return [at]
        left = len(coordinates) - level
        slabs = min(pieces, max(1, int(np.ceil(pieces ** (1 / left) - 1e-9))))
        at = at[np.argsort(x[at, coordinates[level]], kind="stable")]
        return [run for slab in np.array_split(at, slabs) if len(slab) for run in cut(slab, -(-pieces // slabs), level + 1)]

    return cut(np.arange(len(x)), pieces, 0)


def widest(x: np.ndarray, most: int = SLICED) -> list[int]:
    """The coordinates of the largest spread, at most ``most``."""
    return list(np.argsort(-x.astype(float).var(axis=0), kind="stable")[:most]) if len(x) else []


@dataclass
class Cuts:
    """The tiles' cuts: nested slabs of one coordinate each."""

    coordinate: int = -1
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    below: list[Cuts] = field(default_factory=list)
    first: int = 0  # the number of the first tile below

    @staticmethod
    def of(x: np.ndarray, pieces: int, coordinates: list[int], first: int = 0) -> tuple[Cuts, int]:
        """Cuts of the sample ``x`` into about ``pieces`` tiles, and the number after the last tile."""
        if pieces <= 1 or not coordinates or len(x) < 2:
            return Cuts(first=first), first + 1
        slabs = min(pieces, int(np.ceil(pieces ** (1 / len(coordinates)) - 1e-9)))
        c = coordinates[0]
        order = np.sort(x[:, c], kind="stable")
        bounds = np.unique(order[[len(order) * k // slabs for k in range(1, slabs)]])
        side, out = np.searchsorted(bounds, x[:, c], "right"), Cuts(c, bounds, [], first)
        for k in range(len(bounds) + 1):
            below, first = Cuts.of(x[side == k], -(-pieces // slabs), coordinates[1:], first)
            out.below.append(below)
        return out, first

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.first, np.int32)
        if self.below:
            side = np.searchsorted(self.bounds, x[:, self.coordinate], "right")
            for k, below in enumerate(self.below):
                out[side == k] = below.place(x[side == k])
        return out


@dataclass(frozen=True)
class Tiles:
    """The upper entries of the tree: boxes of all tiles, and the number of parts of each."""

    number: np.ndarray
    parts: np.ndarray
    low: np.ndarray   # tiles x coordinates
    high: np.ndarray
    exact: type       # a number type in which all inner products are exact


@dataclass(frozen=True)
class Index:
    entries: DataFrame  # tile, part, kind 0, leaf, id, label, q
    tiles: Tiles
    dims: int


def index(rows: DataFrame, part: int = PART, leaf: int = LEAF, sample: int = SAMPLE, boxes: int = BOXES) -> Index:
    """The tree over ``rows`` (vec_id, label, q with equal sizes): every row is in one leaf.

    Only the cuts depend on the sample (the rows of the smallest hashes of vec_id). A tile of more than ``part`` rows
    is dealt into parts by a hash of vec_id, so equal vectors spread.
    """
    rows = stored(rows, "rows")
    n, dims, top = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.greatest(
        F.abs(F.array_max("q")), F.abs(F.array_min("q"))))).first()
    dims, top = dims or 0, int(top or 0)
    if 100 * dims * top * top >= 1 << 63:
        raise ValueError("inner products of these vectors, times 100, pass 64 bits")
    exact = np.float64 if dims * top * top < 1 << 53 else np.int64
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").toArrow()["q"].combine_chunks()
    x = drawn.flatten().to_numpy().reshape(len(drawn), -1) if len(drawn) and dims else np.zeros((len(drawn), dims), np.int64)
    wanted = max(1, min(n // part, boxes // max(dims, 1), max(1, len(x) // 4)))
    cuts, _ = Cuts.of(x, wanted, widest(x))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = cuts.place(_matrix(batch, dims)) if len(batch) else np.zeros(0, np.int32)
            yield pa.record_batch([pa.array(tile, pa.int32()), *(batch[c] for c in ("vec_id", "label", "q"))],
                                  names=["tile", "vec_id", "label", "q"])

    tiled = stored(rows.select("vec_id", "label", "q").mapInArrow(placed, "tile int, vec_id long, label long, q array<long>"), "tiled")
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    dealt = tiled.join(F.broadcast(sizes), "tile").select(
        "tile", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)").alias("part"), "vec_id", "label", "q")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        x, label = _matrix(table.to_batches()[0], dims), table["label"].to_numpy()
        order, number, k = [], [], 0
        for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(label)) + 1):  # the label is cut first
            for run in slices(x[at], -(-len(at) // leaf), widest(x[at])):
                for few in np.array_split(run, -(-len(run) // leaf)):
                    order.append(at[few])
                    number.append(np.full(len(few), k, np.int32))
                    k += 1
        table = table.take(pa.array(np.concatenate(order))).append_column("leaf", pa.array(np.concatenate(number)))
        return table.select(["tile", "part", "leaf", "vec_id", "label", "q"])

    entries = stored(dealt.groupBy("tile", "part").applyInArrow(
        packed, "tile int, part int, leaf int, vec_id long, label long, q array<long>"), "index")

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            x, tile = _matrix(batch, dims), batch["tile"].to_numpy()
            for t in np.unique(tile).tolist():
                ends = x[tile == t].min(axis=0), x[tile == t].max(axis=0)
                low, high = held.get(t, ends)
                held[t] = np.minimum(low, ends[0]), np.maximum(high, ends[1])
        if held:
            lows, highs = ([list(e[k]) for e in held.values()] for k in (0, 1))
            yield pa.record_batch([pa.array(held, pa.int32()), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))],
                                  names=["tile", "low", "high"])

    boxes_of = entries.select("tile", "q").mapInArrow(boxed, "tile int, low array<long>, high array<long>")
    ends = (boxes_of.select("tile", F.posexplode(F.arrays_zip("low", "high")).alias("at", "v")).groupBy("tile", "at")
            .agg(F.min("v.low").alias("low"), F.max("v.high").alias("high")).orderBy("tile", "at").toArrow())
    parts = dict(sizes.collect())
    number = np.array(sorted(parts), np.int32)
    box = lambda c: ends[c].to_numpy().reshape(len(number), -1).astype(exact) if len(ends) else np.zeros((len(number), 0), exact)
    tiles = Tiles(number, np.array([parts[t] for t in number], np.int32), box("low"), box("high"), exact)
    kinds = (F.lit(0).alias("kind"), "leaf", F.col("vec_id").alias("id"), "label", "q",
             *(F.lit(None).cast("array<long>").alias(c) for c in ("lows", "highs", "kth_score", "kth_id")))
    return Index(entries.select("tile", "part", *kinds), tiles, dims)


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every query (rows of ``q``) with any vector in every box."""
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    return above @ low.T + below @ high.T, above @ high.T + below @ low.T


def routed(queries: DataFrame, tiles: Tiles, first: bool, dims: int) -> DataFrame:
    """One row for every part of every tile that a query has to look at.

    ``first``: the tile with the highest upper end only. Otherwise all others whose interval meets a window of the
    query at or above the k-th score known for it.
    """
    shared, columns = queries.sparkSession.sparkContext.broadcast(tiles), queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = shared.value
        for whole in batches:
            for at in range(0, len(whole) if len(tiles.number) else 0, 1024):
                batch = whole.slice(at, 1024)
                least, most = intervals(_matrix(batch, dims).astype(tiles.exact), tiles.low, tiles.high)
                home = most.argmax(axis=1)
                for i in range(len(batch)):
                    if first:
                        chosen = home[i:i + 1]
                    else:
                        need = np.maximum(_list(batch, "lows", i), _list(batch, "kth_score", i))
                        meets = (most[i][:, None] >= need) & (least[i][:, None] <= _list(batch, "highs", i))
                        meets[home[i]] = False
                        chosen = np.flatnonzero(meets.any(axis=1))
                    if not len(chosen):
                        continue
                    times = tiles.parts[chosen]
                    tile = np.repeat(tiles.number[chosen], times)
                    part = np.concatenate([np.arange(t) for t in times]).astype(np.int32)
                    same = batch.slice(i, 1).take(pa.array(np.zeros(len(tile), np.int32)))
                    yield pa.record_batch([pa.array(tile, pa.int32()), pa.array(part), pa.array(np.ones(len(tile), np.int32)),
                                           pa.array(np.zeros(len(tile), np.int32)), *(same[c] for c in columns)],
                                          names=["tile", "part", "kind", "leaf", *columns])

    return queries.mapInArrow(run, _ENTRY)


class Part:
    """The leaves of one part of a tile, and the best-first search in them."""

    def __init__(self, leaf: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, exact: type):
        self.start = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.end = np.append(self.start[1:], len(leaf))
        self.ids, self.label, self.x = ids, label, x.astype(exact)
        self.low, self.high = np.minimum.reduceat(self.x, self.start), np.maximum.reduceat(self.x, self.start)
        self.least_id = np.minimum.reduceat(ids, self.start)
        self.least_label, self.most_label = np.minimum.reduceat(label, self.start), np.maximum.reduceat(label, self.start)

    def search(self, q, bounds, anchor: int, label: int, lows, highs, kth, k: int, same: bool) -> list[list[tuple]]:
        """The first ``k`` rows (-score, id) of every window that are not worse than the window's k-th row ``kth``."""
        least, most = bounds
        right = (self.least_label <= label) & (self.most_label >= label) if same else (self.least_label != label) | (self.most_label != label)
        found, floor = [[] for _ in lows], min(max(a, b[0]) for a, b in zip(lows, kth))
        right &= (most >= floor) & (least <= max(highs))
        queue = [(-most[b], self.least_id[b], b) for b in np.flatnonzero(right)]
        heapq.heapify(queue)
        last = [(-s, i) for s, i in kth]
        while queue:
            end, least_id, b = heapq.heappop(queue)
            if -end < floor:
                break
            open_ = [w for w in range(len(lows)) if -end >= lows[w] and least[b] <= highs[w] and (end, least_id) <= last[w]]
            if not open_:
                continue
            at = slice(self.start[b], self.end[b])
            score = self.x[at] @ q
            fits = (self.label[at] == label if same else self.label[at] != label) & (score >= floor) & (self.ids[at] != anchor)
            rows = np.flatnonzero(fits)
            if not len(rows):
                continue
            for w in open_:
                for s, i in zip(score[rows].tolist(), self.ids[at][rows].tolist()):
                    if lows[w] <= s <= highs[w] and (-s, i) <= last[w]:
                        found[w].append((-s, i))
                if len(found[w]) >= k:
                    found[w] = sorted(found[w])[:k]
                    last[w] = min(last[w], found[w][-1])
            floor = min(max(a, -b[0]) for a, b in zip(lows, last))
        return [sorted(f)[:k] for f in found]


def searched(entries: DataFrame, routes: DataFrame, tiles: Tiles, dims: int, k: int, same: bool) -> DataFrame:
    """Every routed query searched in its part: rows and queries of a part meet in one task, the rows first."""
    exact = tiles.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held = None, None, []
        for batch in batches:
            tile, number, kind = (batch[c].to_numpy() for c in ("tile", "part", "kind"))
            edges = np.flatnonzero((np.diff(tile) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(batch))):
                if a == b:
                    continue
                if (tile[a], number[a]) != key:
                    part, key, held = None, (tile[a], number[a]), []
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((rows["leaf"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, dims)))
                    continue
                if held:
                    part, held = Part(*(np.concatenate(c) for c in zip(*held)), exact), []
                if part is None:
                    continue
                for at in range(0, len(rows), 1024):
                    yield from answered(part, rows.slice(at, 1024))

    def answered(part: Part, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = _matrix(batch, dims).astype(exact)
        least, most = intervals(q, part.low, part.high)
        out: list[tuple] = []
        for i, (anchor, label) in enumerate(zip(batch["id"].to_pylist(), batch["label"].to_pylist())):
            kth = list(zip(_list(batch, "kth_score", i).tolist(), _list(batch, "kth_id", i).tolist()))
            found = part.search(q[i], (least[i], most[i]), anchor, label, _list(batch, "lows", i).tolist(),
                                _list(batch, "highs", i).tolist(), kth, k, same)
            out += [(anchor, w, int(-s), r) for w, f in enumerate(found) for s, r in f]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                  names=["anchor_id", "w", "score", "id"])

    met = entries.unionByName(routes).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind", "leaf")
    return met.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(tree: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, w, score, id, rank: the first ``k`` rows of every window of every query, by (score, -id) downwards.

    queries: id, label, q, lows, highs (one entry a window). Rows of the query's label count (``same``), or all others;
    the row that has the query's id never does. The tile with the highest upper end is searched first; its k-th
    scores prune all other tiles and their boxes.
    """
    open_ = lambda v: F.transform("lows", lambda _: F.lit(v).cast("long"))
    blank = stored(queries.select("id", "label", "q", "lows", "highs", open_(LEAST).alias("kth_score"), open_(MOST).alias("kth_id")), "queries")
    near = stored(_best(searched(tree.entries, routed(blank, tree.tiles, True, tree.dims), tree.tiles, tree.dims, k, same), k), "near")
    last = near.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("w", F.struct("score", F.col("id").alias("row"))))).alias("last"))
    known = blank.join(last, "id", "left")
    entry = lambda name, other: F.transform("lows", lambda _, w: F.coalesce(F.col("last")[w.cast("int")][name], F.lit(other).cast("long")))
    known = stored(known.select("id", "label", "q", "lows", "highs", entry("score", LEAST).alias("kth_score"),
                                entry("row", MOST).alias("kth_id")), "queries")
    rest = searched(tree.entries, routed(known, tree.tiles, False, tree.dims), tree.tiles, tree.dims, k, same)
    return _best(near.select("anchor_id", "w", "score", "id").unionByName(rest), k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80, **sizes) -> DataFrame:
    """For every anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score is between ``share`` percent of the positive's and the positive's.

    rows: vec_id (a key), label, q as vectors() gives them; anchors: a condition on them. Higher scores come first,
    ties by smaller id. Pairs without such a row, anchors without a positive and empty tables give no rows.
    """
    rows = stored(rows, "vectors")
    tree = index(rows, **sizes)
    asked = rows.where(anchors).select(F.col("vec_id").alias("id"), "label", "q")
    everything = [F.array(F.lit(v).cast("long")) for v in (LEAST, MOST)]
    near = stored(nearest(tree, asked.select("*", everything[0].alias("lows"), everything[1].alias("highs")), positives, True)
                  .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    least_share = f"({share} * x.positive_score + if(x.positive_score > 0, 99, 0)) div 100"  # rounded up
    ranked = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    windows = asked.join(ranked, "id").select(
        "id", "label", "q", F.expr(f"transform(p, x -> {least_share})").alias("lows"), F.expr("p.positive_score").alias("highs"))
    found = nearest(tree, windows, negatives, False)
    return (found.withColumnRenamed("rank", "place").join(near.withColumn("w", F.col("rank") - 1).drop("rank"), ["anchor_id", "w"])
            .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of ids divisible by 7 move up by one first."""
    table = read(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(table.select("vec_id", moved.alias("label"), "embedding")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label,
           list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
    SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
     AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""
