"""Noise clusters: senders that belong together by unsubscribe target, list id or domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark.functions.headers import is_seen
from mailspark.session import checkpointed


def unsubscribe_target(link: Column) -> Column:
    """What an unsubscribe link leads to: the address of a mailto, else host and path, without tracking; null for others."""
    text = F.trim(link)
    mail = F.lower(F.regexp_extract(text, r"(?i)^mailto:([^?\s]+)", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"(?i)^https?://(?:[^/@?#\s]*@)?([^/:?#\s]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(text, r"(?i)^https?://[^/?#\s]+(/[^?#\s]*)", 1), "/+$", "")
    return F.when(mail != "", mail).when(host != "", F.concat(host, path))


def memberships(messages: DataFrame) -> DataFrame:
    """node, key of each sender and what it shares with others: target, list id, domain; each pair once."""
    sender = F.lower(F.trim("from_addr"))
    tagged = lambda tag, c: F.when(F.length(c) > 0, F.concat(F.lit(tag), c))
    keys = F.array(tagged("target:", unsubscribe_target(F.col("unsubscribe"))), tagged("list:", F.lower(F.trim("list_id"))),
                   tagged("domain:", F.regexp_extract(sender, "@([^@]+)$", 1)))
    pairs = messages.where(F.length(F.trim("from_addr")) > 0).select(sender.alias("node"), F.explode(keys).alias("key"))
    return pairs.where("key is not null").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes that share keys (node, key).

    Each round every key takes the least label of its nodes, every node the least of its keys, and then the label of
    its label; a label thus leaps over what earlier rounds joined. A round ends in a checkpoint, and the last one finds
    nothing to change. Groups are met by minima that combine before the shuffle, so a key with very many nodes is one
    row of each task.
    """
    pairs = checkpointed(pairs.select("node", "key").distinct())
    labels = checkpointed(pairs.select("node", F.col("node").alias("root")).distinct())
    while True:
        of_key = pairs.join(labels, "node").groupBy("key").agg(F.min("root").alias("root"))
        near = pairs.join(of_key, "key").groupBy("node").agg(F.min("root").alias("near"))
        onward = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        moved = checkpointed(labels.join(near, "node").join(onward, "near").select(
            "node", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("root")).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels


def noise_components(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Bulk senders that belong together, with how much is unread and where they can be left.

    messages: from_addr, list_id, unsubscribe, flags, received_at. Senders are one cluster if a chain of shared
    unsubscribe targets, list ids or domains joins them; ``cluster`` is the least address. Anyone whom the user
    answered (contacts: addr, replied_count) is left out before. Rows without an address are left out.
    """
    sender = F.lower(F.trim("from_addr"))
    known = contacts.where("replied_count > 0").select(F.lower(F.trim("addr")).alias("node")).distinct()
    rows = messages.where(F.length(F.trim("from_addr")) > 0).withColumn("node", sender).join(known, "node", "left_anti")
    placed = components(memberships(rows))
    per_sender = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(~is_seen(F.col("flags"))).alias("unread"),
        F.count_if(F.length("list_id") > 0).alias("listed"), F.max("received_at").alias("last_seen_at"),
        F.min(unsubscribe_target(F.col("unsubscribe"))).alias("target"))
    joined = per_sender.join(placed, "node", "left").withColumn("cluster", F.coalesce("root", "node"))
    return joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("senders"), F.sum("messages").alias("messages"), F.sum("unread").alias("unread"),
        F.sum("listed").alias("listed"), F.max("last_seen_at").alias("last_seen_at"), F.min("target").alias("target"))
