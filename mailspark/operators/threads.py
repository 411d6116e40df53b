"""Conversation threads: parent links resolved by joins, roots and depths by pointer doubling.

A message joins the thread of the message it answers when that one is older; an answer to an unknown id opens a
ghost thread; References are the second choice, deepest known ancestor first. What the reading order decides
("known by then") is expressed as comparisons of (received_at, id), so nothing is processed row after row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from mailspark import lexicon as lx
from mailspark.functions.common import contains_any
from mailspark.functions.fingerprint import normalize_title
from mailspark.session import checkpointed

SYNTHETIC = "sha256:"


def _place(prefix: str = "") -> Column:
    """Reading order as a comparable struct; undated messages come first."""
    return F.struct(F.col(f"{prefix}received_at").alias("t"), F.col(f"{prefix}id").alias("i"))


def load_nodes(messages: DataFrame) -> DataFrame:
    """Canonical, live messages as graph nodes."""
    digest = F.coalesce("body_sha256", F.concat(F.lit("row"), F.col("id").cast("string")))
    mid = F.when(F.length("normalized_message_id") > 0, F.col("normalized_message_id"))
    return messages.where("is_canonical and not stale").select(
        "id", mid.alias("mid"), F.when(F.length("in_reply_to") > 0, F.col("in_reply_to")).alias("irt"),
        F.coalesce("references_ids", F.expr("cast(array() as array<string>)")).alias("refs"),
        normalize_title(F.col("subject")).alias("subject_norm"), "received_at",
        F.lower(F.coalesce("from_addr", F.lit(""))).alias("from_addr"),
        (F.coalesce(F.length("auto_submitted"), F.lit(0)) > 0).alias("machine"),
        F.coalesce(mid, F.concat(F.lit(SYNTHETIC), F.substring(digest, 1, 16))).alias("own_key"),
        _place().alias("place"))


def first_holders(nodes: DataFrame) -> DataFrame:
    """The earliest message of every id."""
    return (nodes.where("mid is not null").groupBy("mid")
            .agg(F.min("place").alias("h_place"))
            .select("mid", "h_place", F.col("h_place.i").alias("h_id")))


def _links(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """Per node: the parent found through In-Reply-To, the ghost it opens, or the References it falls back to."""
    answered = holders.select(F.col("mid").alias("irt"), F.col("h_id").alias("irt_id"), F.col("h_place").alias("irt_place"))
    step = (nodes.join(answered, "irt", "left")
            .withColumn("irt_older", F.coalesce(F.col("irt_place") < F.col("place"), F.lit(False)))
            .withColumn("opens_ghost", F.col("irt").isNotNull() & F.col("irt_id").isNull()))
    return step


def _depth_of_all(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """Chain length of every id holder over the whole corpus; -1 when the chain runs into a cycle.

    A holder points to the holder of its first known link: the answered id, else the last known reference.
    """
    links = nodes.join(holders.select(F.col("h_id").alias("id")), "id", "left_semi").select(
        "id", F.concat(F.array("irt"), F.reverse("refs")).alias("links"))
    pointers = (links.select("id", F.posexplode("links").alias("rank", "mid"))
                .join(holders.select("mid", "h_id"), "mid")
                .groupBy("id").agg(F.min_by("h_id", "rank").alias("ptr")))
    state = checkpointed(holders.select(F.col("h_id").alias("id")).join(pointers, "id", "left").select(
        "id", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    rounds = max(1, math.ceil(math.log2(max(2, state.count())))) + 1
    for _ in range(rounds):
        if state.where("ptr is not null").isEmpty():
            break
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("n_ptr"), F.col("dist").alias("n_dist"))
        moving = state.where("ptr is not null").join(ahead, "ptr").select(
            "id", F.col("n_ptr").alias("ptr"), (F.col("dist") + F.col("n_dist")).alias("dist"))
        state = checkpointed(state.where("ptr is null").unionByName(moving))
    return state.select("id", F.when(F.col("ptr").isNull(), F.col("dist")).otherwise(F.lit(-1)).alias("depth"))


def _by_references(step: DataFrame, holders: DataFrame, ghosts: DataFrame, depths: DataFrame) -> DataFrame:
    """(id, ref_parent, ref_ghost, cycle) for nodes that fall back to References.

    Deepest known ancestor wins, the first on ties; an unknown reference counts with its position, and only when
    an earlier message had already opened a thread for it.
    """
    open_refs = (step.where("not irt_older and not opens_ghost and size(refs) > 0")
                 .select("id", "place", F.posexplode("refs").alias("pos", "ref")))
    known = (open_refs.join(holders.withColumnRenamed("mid", "ref"), "ref")
             .join(depths.select(F.col("id").alias("h_id"), "depth"), "h_id")
             .select("id", "pos", F.col("depth").cast("long").alias("value"),
                     F.when(F.col("h_place") < F.col("place"), F.col("h_id")).alias("parent"),
                     F.lit(None).cast("string").alias("ghost")))
    unknown = (open_refs.join(ghosts.withColumnRenamed("key", "ref"), "ref")
               .where(F.col("g_place") < F.col("place"))
               .select("id", "pos", F.col("pos").cast("long").alias("value"), F.lit(None).cast("long").alias("parent"),
                       F.col("ref").alias("ghost")))
    best = F.struct(F.col("value").alias("value"), (-F.col("pos")).alias("first"), F.col("parent").alias("parent"),
                    F.col("ghost").alias("ghost"))
    return (known.unionByName(unknown).groupBy("id")
            .agg(F.max(F.when(F.col("value") >= 0, best)).alias("b"), F.max(F.col("value") < 0).alias("cycle"))
            .select("id", F.col("b.parent").alias("ref_parent"), F.col("b.ghost").alias("ref_ghost"), "cycle"))


def resolve_parents(nodes: DataFrame) -> DataFrame:
    """(id, parent, root_key, cycle): either an older parent, or the key of the thread the node itself anchors."""
    holders = checkpointed(first_holders(nodes))
    step = checkpointed(_links(nodes, holders))
    needs_refs = not step.where("not irt_older and not opens_ghost and size(refs) > 0").isEmpty()
    depths = _depth_of_all(nodes, holders) if needs_refs else None
    # a later copy of an id can only matter where some id has more than one holder
    copies = step.join(holders.select(F.col("h_id").alias("id")), "id", "left_anti").where("mid is not null")
    has_copies = not copies.isEmpty()
    anchors = None
    while True:
        openers = step.where("opens_ghost")
        if anchors is not None:
            openers = openers.join(anchors, "mid", "left").where("a_place is null or place <= a_place")
        ghosts = openers.groupBy(F.col("irt").alias("key")).agg(F.min("place").alias("g_place"))
        linked = step
        if needs_refs:
            linked = step.join(_by_references(step, holders, ghosts, depths), "id", "left")
        else:
            linked = step.withColumns({"ref_parent": F.lit(None).cast("long"), "ref_ghost": F.lit(None).cast("string"),
                                       "cycle": F.lit(False)})
        parent = F.when(F.col("irt_older"), F.col("irt_id")).when(~F.col("opens_ghost"), F.col("ref_parent"))
        ghost = F.when(F.col("opens_ghost"), F.col("irt")).when(~F.col("irt_older"), F.col("ref_ghost"))
        linked = linked.withColumns({"parent": parent, "ghost": ghost})
        if not has_copies:
            break
        # the first copy that anchors its own id collects every later copy of that id
        found = checkpointed(linked.where("mid is not null and parent is null and ghost is null")
                             .groupBy("mid").agg(F.min("place").alias("a_place")))
        settled = anchors is not None and found.exceptAll(anchors).isEmpty() and anchors.exceptAll(found).isEmpty()
        anchors = found
        if settled:
            break
    if anchors is not None:
        linked = linked.join(anchors, "mid", "left")
        late = F.coalesce(F.col("place") > F.col("a_place"), F.lit(False))
        linked = linked.withColumns({
            "root_key": F.when(late, F.col("mid")).otherwise(F.coalesce("ghost", F.when(
                F.col("parent").isNull(), F.col("own_key")))),
            "parent": F.when(~late, F.col("parent")), "cycle": ~late & F.coalesce("cycle", F.lit(False))})
    else:
        linked = linked.withColumn("root_key", F.coalesce("ghost", F.when(F.col("parent").isNull(), F.col("own_key"))))
    by_refs = ~F.col("irt_older") & ~F.col("opens_ghost")
    counted = F.coalesce("cycle", F.lit(False)) & by_refs & (F.col("parent").isNotNull() | F.col("ghost").isNotNull())
    return linked.select("id", "parent", "root_key", counted.alias("cycle"))


def follow_to_root(parents: DataFrame) -> DataFrame:
    """(id, root_key) for every node: each round doubles the distance a pointer covers."""
    # chains only lead over nodes that are somebody's parent; the others never travel again
    targets = parents.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn(
        "is_parent", F.lit(True))
    state = checkpointed(parents.select("id", "parent", "root_key").join(targets, "id", "left"))
    finished = [state.where("parent is null").select("id", "root_key", "is_parent")]
    active = state.where("parent is not null")
    while not active.isEmpty():
        jump = active.where("is_parent").select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        ends = finished[0]
        for part in finished[1:]:
            ends = ends.unionByName(part)
        ends = ends.where("is_parent").select(F.col("id").alias("parent"), F.col("root_key").alias("end"))
        stepped = checkpointed(
            active.join(ends, "parent", "left").join(jump, "parent", "left")
            .select("id", F.coalesce("next", "parent").alias("parent"), F.col("end").alias("root_key"), "is_parent"))
        finished.append(stepped.where("root_key is not null").select("id", "root_key", "is_parent"))
        active = stepped.where("root_key is null")
    done = finished[0]
    for part in finished[1:]:
        done = done.unionByName(part)
    return done.select("id", "root_key")


def assign_threads(messages: DataFrame) -> DataFrame:
    """One row per message: root_key, strength, ghost mark, cycle mark, and whether it came in by subject only."""
    nodes = checkpointed(load_nodes(messages))
    parents = checkpointed(resolve_parents(nodes))
    roots = follow_to_root(parents)
    placed = nodes.join(roots, "id").join(parents.select("id", "cycle"), "id")
    known = nodes.where("mid is not null").select(F.col("mid").alias("root_key")).distinct().withColumn(
        "is_known", F.lit(True))
    sizes = placed.groupBy("root_key").agg(F.count(F.lit(1)).alias("size"))
    synthetic = F.startswith(F.col("root_key"), F.lit(SYNTHETIC))
    threads = sizes.join(known, "root_key", "left").select(
        "root_key", "size", (~synthetic & F.col("is_known").isNull()).alias("is_ghost"))
    placed = placed.join(threads, "root_key")
    merged = _weak_merge(placed)
    return (placed.join(merged, "root_key", "left")
            .select("id", F.coalesce("keeper", "root_key").alias("root_key"),
                    F.when(F.col("keeper").isNotNull(), F.lit("weak")).otherwise(F.lit("strong")).alias("strength"),
                    "is_ghost", "cycle",
                    F.coalesce(F.col("keeper") != F.col("root_key"), F.lit(False)).alias("by_subject"),
                    "mid", "subject_norm", "received_at", "from_addr", "place"))


def _weak_merge(placed: DataFrame) -> DataFrame:
    """(root_key, keeper) of single messages without any link that share a subject no machine would send."""
    lonely = placed.where(
        (F.col("size") == 1) & ~F.col("is_ghost") & F.col("irt").isNull() & (F.size("refs") == 0)
        & (F.col("subject_norm") != "") & ~F.col("machine")
        & ~contains_any(F.col("subject_norm"), lx.AUTOMATED_SUBJECT_HINTS))
    groups = (lonely.groupBy("subject_norm")
              .agg(F.min_by("root_key", "place").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return lonely.select("root_key", "subject_norm").join(groups, "subject_norm").select("root_key", "keeper")


def thread_table(assigned: DataFrame, own_addresses: list[str] | None = None, account: str | None = None) -> DataFrame:
    """The threads table: root, first subject, last message and its direction, strength, status."""
    own = [a.strip().lower() for a in own_addresses or [] if a.strip()]
    direction = F.when(F.col("from_addr").isin(*own), "out").otherwise("in") if own else F.lit("in")
    grouped = assigned.withColumn("direction", direction).groupBy("root_key").agg(
        F.min("place").alias("first"), F.min_by("subject_norm", "place").alias("subject_norm"),
        F.max_by("direction", "place").alias("last_direction"),
        F.max_by("received_at", "place").alias("last_message_at"), F.max("strength").alias("link_strength"),
        F.max("is_ghost").alias("is_ghost"), F.count(F.lit(1)).alias("n"))
    return grouped.select(
        F.col("first.i").alias("id"), F.lit(account).alias("account"), F.col("root_key").alias("root_message_id"),
        "subject_norm", "last_direction", "last_message_at", "link_strength",
        F.when(F.col("is_ghost"), "ghost").otherwise("active").alias("status"), "n")


def rebuild(messages: DataFrame, own_addresses: list[str] | None = None, account: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(threads, message_thread) from scratch; the thread id is the id of its first message."""
    assigned = checkpointed(assign_threads(messages))
    threads = thread_table(assigned, own_addresses, account)
    ids = threads.select(F.col("root_message_id").alias("root_key"), F.col("id").alias("thread_id"))
    return threads, assigned.join(ids, "root_key").select("id", "thread_id", "root_key", "strength")


def thread_stats(assigned: DataFrame) -> DataFrame:
    """One row: messages, threads, strong, weak, ghosts, orphaned_by_missing_id, cycles_broken, merged_by_subject."""
    per_thread = assigned.groupBy("root_key").agg(F.max("strength").alias("s"), F.max("is_ghost").alias("g"))
    threads = per_thread.agg(
        F.count(F.lit(1)).alias("threads"), F.count_if(F.col("s") == "strong").alias("strong"),
        F.count_if(F.col("s") == "weak").alias("weak"), F.count_if("g").alias("ghosts"))
    nodes = assigned.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("mid").isNull()).alias("orphaned_by_missing_id"),
        F.count_if("cycle").alias("cycles_broken"), F.count_if("by_subject").alias("merged_by_subject"))
    both = nodes.unionByName(threads, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def longest_threads(threads: DataFrame, messages: DataFrame, limit: int = 10) -> DataFrame:
    """Threads of more than one message, largest first."""
    sizes = messages.where("thread_id is not null").groupBy(F.col("thread_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")
    return (threads.drop("n").join(sizes, "id")
            .select("id", "root_message_id", "subject_norm", "link_strength", "last_message_at", "n")
            .orderBy(F.desc("n"), F.desc("last_message_at"), "id").limit(limit))
