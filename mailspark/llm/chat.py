"""Perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read

#: Roles that set the scene and take no part.
SCENE = ("system",)
#: Turn numbers of one part; a longer dialogue has several parts.
PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def speaker(role: Column) -> Column:
    """A role as a name: anything that could break a header is an underscore; no role is ``unknown``."""
    name = F.regexp_replace(role, r"[^\p{L}\p{N}_.-]+", "_")
    return F.when(F.coalesce(F.length(name), F.lit(0)) > 0, name).otherwise(F.lit("unknown"))


def quoted(text: Column) -> Column:
    """A turn's text in which the markers of the format no longer read as such."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<_|im_"))


def rotations(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_own, text, spans for every participant of every dialogue of ``turns``
    (conv_id, turn, role, text).

    In each rotation the turns of one participant are the assistant's and those of the others a named user's; scene
    roles stay what they are. ``spans`` are the character ranges [start, end) of ``text`` that a loss covers: what
    the assistant says and the marker that ends it.

    Part k holds the turn numbers k * part .. (k + 1) * part - 1, so a task gathers so many turns at a time and not a
    whole dialogue; the parts' texts in order are the dialogue. Turns stand in the order of (turn, role, text).

    Null texts are empty turns. A null role is ``unknown``; a null turn number counts as -1. Rows without a conv_id
    are dialogues of one turn each (equal rows together). Repeated rows are repeated turns. A dialogue of scene roles
    alone has no participant and no rotation. Empty tables give no rows.
    """
    name = speaker(F.col("role"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = turns.select("conv_id", alone.alias("solo"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
                        name.alias("name"), quoted(F.col("text")).alias("text"))
    dialogue = ["conv_id", "solo"]
    parts = (rows.groupBy(*dialogue, F.floor(F.col("turn") / part).alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("turn", "name", "text"))).alias("turns")))
    people = rows.where(~F.col("name").isin(*SCENE)).select(
        F.col("conv_id").alias("c"), F.col("solo").alias("s"), F.col("name").alias("perspective")).distinct()
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("solo").eqNullSafe(F.col("s")))

    def head(t: Column) -> Column:
        label = F.when(t["name"] == F.col("perspective"), F.lit("assistant")).when(
            t["name"].isin(*SCENE), t["name"]).otherwise(F.concat(F.lit("user name="), t["name"]))
        return F.concat(F.lit(OPEN), label, F.lit("\n"))

    said = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["name"] == F.col("perspective")).alias("own")))
    each = each.select("conv_id", "perspective", "part", said.alias("said"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["own"], F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    text = F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    return each.select(
        "conv_id", "perspective", "part", F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda t: t["own"])).cast("long").alias("n_own"), text.alias("text"),
        F.aggregate("said", start, step, lambda done: done["spans"]).alias("spans"))


def op3_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """All rotations; spans as text, start-end each."""
    done = rotations(read(spark, folder, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return done.withColumn("spans", spans)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(regexp_replace(role, '[^\p{L}\p{N}_.-]+', '_', 'g'), ''), 'unknown') AS name,
         replace(coalesce(text, ''), '<|im_', '<_|im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
r AS (
  SELECT t.conv_id, perspective, floor(turn / 256)::BIGINT AS part, turn, name, text, name = perspective AS own,
         '<|im_start|>' || CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN name
                                ELSE 'user name=' || name END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY turn, name, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY turn, name, text) AS text,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ' ' ORDER BY turn, name, text) FILTER (own), '') AS spans
FROM o GROUP BY ALL
"""
