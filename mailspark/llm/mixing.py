"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailspark.llm.tables import read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Document ids that differ by less than this lie in one block of a source's order.
BLOCK = 1024
#: Anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size): source_size and its target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``most`` times its source's size; what is above goes to the others by weight until none is above. That
    fixed point is a water level: with sources in the order of (cap / weight), the first k are capped, the others
    get level * weight, and the level is what the caps leave over the weights that they leave. k is the smallest
    number for which no uncapped source is above its cap.

    Sources are few against documents: one row each reaches the two windows that are not partitioned.
    A source without words gets the target 0. An empty input gives no rows.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy(F.lit(0))
    level_order = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (weighed
              .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("_weights", F.sum("_w").over(everything))
              .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
              .withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
              .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
              .withColumn("_fits", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))))
    # all caps before the first that fits are reached; the levels after it are of no use
    ranked = ranked.withColumn("_water", F.first("_fits", ignorenulls=True).over(
        level_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_water") * F.col("_w")))
    return ranked.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The one random start of a source, a multiple of 1/4096 below 1 that depends on the seed and the source alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / F.lit(4096.0)


def sample(docs: DataFrame, size: Column, seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = SHARE,
           most: float = MOST) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies: how often the mix takes the row.

    Every row of a source expects target / source_size copies. Within the source rows stand in the order of (size,
    doc_id), so sums of sizes run close to their expectation; with P the running sum of expected copies and u the
    source's offset, a row is emitted once per whole number in (P_before + u, P + u].

    The running sum is a rank, built in three levels so that a hot source never meets in one task: sizes within the
    source, blocks of BLOCK ids within a size, rows within a block.

    Null text: size 0. Null source: a source of its own. Null ids stand first in their block. Rows that repeat a
    doc_id are rows of their own. Columns of ``docs`` may have any names but those with a leading underscore that
    this function adds.
    """
    block = F.floor(F.col("doc_id") / BLOCK)
    rows = docs.withColumn("_size", size).withColumn("_block", block)
    thin = rows.select(F.col("source"), F.col("_size").alias("size"), F.col("_block").alias("block"))
    goals = targets(thin, weights, share, most)
    blocks = thin.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    in_size = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (blocks.groupBy("source", "size").agg(F.sum("n").alias("n"))
             .withColumn("_below", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n"))
    starts = blocks.withColumn("_within", F.coalesce(F.sum("n").over(in_size), F.lit(0))).drop("n")
    starts = (starts.alias("b").join(sizes.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))
                                     & (F.col("b.size") == F.col("s.size")))
              .join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
              .select(F.col("b.source").alias("_s"), F.col("b.size").alias("_z"), F.col("b.block").alias("_b"),
                      (F.col("_below") + F.col("_within")).alias("_start"), F.col("source_size").alias("_source_size"),
                      F.col("target").alias("_target")))
    inside = Window.partitionBy("source", "_size", "_block").orderBy("doc_id")
    placed = rows.withColumn("_row", F.row_number().over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
        & F.col("_block").eqNullSafe(F.col("_b")))
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    rank, u = F.col("_start") + F.col("_row"), offset(F.col("source"), seed)
    copies = F.floor(rank * expected + u) - F.floor((rank - 1) * expected + u)
    copies = F.least(copies, F.lit(int(-(-most // 1))))  # rounding of the sum may not break the contract
    return placed.withColumn("_copies", copies).drop("_s", "_z", "_b", "_block", "_row", "_start")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row as often as it is taken, with the columns of ``docs``."""
    taken = sample(docs, word_count(F.col("text")), **options).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document. The texts stay out of the shuffle: only their sizes are ranked."""
    docs = read(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    taken = sample(docs, F.col("n"))
    return taken.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
-- share by weight, stop what is above its cap, share the rest again
rounds AS (
  SELECT 0 AS k, source, source_size, w, false AS capped,
         1.5 * (SELECT sum(source_size) FROM s) * w / (SELECT sum(w) FROM w) AS target FROM w
  UNION ALL
  SELECT k + 1, source, source_size, w, capped OR target > 2.0 * source_size,
         CASE WHEN capped OR target > 2.0 * source_size THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (capped OR target > 2.0 * source_size) OVER (), 0))
                   * w / sum(w) FILTER (NOT (capped OR target > 2.0 * source_size)) OVER () END
  FROM rounds WHERE k < (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, target FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
r AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank,
             ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 3))::INT / 4096.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rank * e + u) - floor((rank - 1) * e + u), 2))::BIGINT AS taken FROM r
"""
