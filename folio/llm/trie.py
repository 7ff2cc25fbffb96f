"""The trie of conversation prefixes, with totals of subtrees rolled up by bands of depth (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, running, solid, written

#: Depths of a band: a node is copied to so many ancestors at most in a round, and each round leaves one depth of so many.
BAND = 8
#: Turns that are summed up in one go when prefixes get their digests.
CHUNK = 1_024
#: A digest is the sum of these pieces, 32 bits of each turn's SHA-256, so sums of two billion turns fit.
PIECES = 5


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_sha256, n_bytes of every turn of every conversation with an id.

    Turns are ordered by turn, null first, then role, then the SHA-256 of the text; null roles and texts are empty. Ranges of that order
    are numbered one by one, so that a conversation with very many turns is spread over tasks.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), F.sha2(text, 256).alias("_text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    rows = rows.repartitionByRange(F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")).withColumn("_range", F.spark_partition_id())
    placed = running(written(rows), {"place": F.lit(1)}, ["conv_id"], "_range", [F.col("_turn").asc_nulls_first(), "_role", "_text"])
    return placed.select("conv_id", "place", F.sha2(F.concat(F.length("_role"), F.lit(":"), "_role", "_text"), 256).alias("turn_sha256"), "n_bytes")


def shared_openings(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The conversations rebuilt: conv_id, place, turn_sha256, n_bytes, and a row with a null place for a conversation that is left without turns.

    Conversation c gets the first h turns of conversation c - c % group, then its own after its first h; h is
    crc32(c in decimals) % (most + 1).
    """
    turns = written(turns)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_turns"))
    convs = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "_base")
    held = opening.groupBy("_base").agg(F.count("*").alias("_held"))
    convs = written(convs.join(held, "_base", "left").withColumn("_first", F.least("_head", F.coalesce("_held", F.lit(0)))))
    taken = convs.join(opening, "_base").where("place < _first").select("conv_id", "place", "turn_sha256", "n_bytes")
    own = meet(turns, convs.select("conv_id", "_turns", "_head", "_first"), ["conv_id"], "_turns").where("place >= _head")
    own = own.select("conv_id", (F.col("place") - F.col("_head") + F.col("_first")).alias("place"), "turn_sha256", "n_bytes")
    bare = convs.where((F.col("_first") == 0) & (F.col("_turns") <= F.col("_head"))).select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("turn_sha256"), F.lit(0).cast("long").alias("n_bytes"))
    return taken.unionByName(own).unionByName(bare)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_bytes, last: a row for every prefix of every conversation, the empty one included; last marks the whole conversation.

    The key of a prefix is a digest of the sums, over its turns, of the pieces of SHA-256 of place and turn. Sums can be made in parts, so
    a long conversation needs no task of its own.
    """
    hexed = F.sha2(F.concat_ws(":", "place", "turn_sha256"), 256)
    rows = rebuilt.withColumn("_hex", hexed).withColumn("_chunk", F.floor(F.coalesce("place", F.lit(0)) / CHUNK))
    piece = [F.when(F.col("place").isNull(), F.lit(0)).otherwise(F.conv(F.substring("_hex", 8 * i + 1, 8), 16, 10)).cast("long") for i in range(PIECES)]
    rows = written(rows.select("conv_id", "place", "n_bytes", "_chunk", *(p.alias(f"_p{i}") for i, p in enumerate(piece))))
    sums = running(rows, {f"_s{i}": f"_p{i}" for i in range(PIECES)}, ["conv_id"], "_chunk", ["place"])
    name = lambda depth, some: F.unhex(F.sha2(F.concat_ws(":", depth, *some), 256))
    before = name(F.col("place"), [F.col(f"_s{i}") for i in range(PIECES)])
    key = name(F.col("place") + 1, [F.col(f"_s{i}") + F.col(f"_p{i}") for i in range(PIECES)])
    length = rows.groupBy("conv_id").agg(F.count("place").alias("_length"), F.count("*").alias("_rows"))
    length = written(length)
    turns = meet(written(sums.where("place is not null").select("conv_id", (F.col("place") + 1).alias("depth"), key.alias("key"), before.alias("parent"), "n_bytes")), length, ["conv_id"], "_rows")
    root = name(F.lit(0).cast("long"), [F.lit(0).cast("long")] * PIECES)
    tops = length.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), (F.col("_length") == 0).alias("last"))
    return turns.select("conv_id", "depth", "key", "parent", "n_bytes", (F.col("depth") == F.col("_length")).alias("last")).unionByName(tops)


def subtree_totals(nodes: DataFrame, paths: DataFrame, sums: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """key and sums, each summed over the subtree of every node, its top included.

    nodes has key, conv_id, depth and sums; paths has conv_id, depth and key of the node at every depth of each conversation. A node is copied
    to its ancestors within its band of depths only. The tops of bands, a tree of a depth ``band`` times smaller, get their whole totals
    in the same way, and hand them to the band above. So there are log(deepest) rounds, with 2 x band copies of a node at most in each.
    """
    lists = paths.groupBy("conv_id", F.floor(F.col("depth") / band).alias("_band")).agg(F.collect_list(F.struct("depth", "key")).alias("_path"))
    lists = written(lists)

    def spread(some: DataFrame, above: int, upto: Column) -> DataFrame:
        """some summed up at the ancestors, in the band so many above, that are not deeper than upto."""
        own = some.withColumn("_band", F.floor(F.col("depth") / band) - above).join(lists, ["conv_id", "_band"])
        own = own.select(F.explode(F.filter("_path", lambda p: p["depth"] <= upto)).alias("_at"), *sums)
        return own.groupBy(F.col("_at.key").alias("key")).agg(*(F.sum(c).alias(c) for c in sums))

    inside = spread(nodes, 0, F.col("depth"))
    if deepest < band:
        return inside
    inside = written(inside)
    tops = nodes.where(F.col("depth") % band == 0).select("key", "conv_id", (F.col("depth") / band).cast("long").alias("depth")).join(inside, "key")
    upper = paths.where(F.col("depth") % band == 0).select("conv_id", (F.col("depth") / band).cast("long").alias("depth"), "key")
    whole = subtree_totals(written(tops), upper, sums, deepest // band, band)
    named = tops.select("key", "conv_id", (F.col("depth") * band).alias("depth")).where("depth > 0").join(whole, "key")
    return inside.unionByName(spread(named, 1, F.col("depth"))).groupBy("key").agg(*(F.sum(c).alias(c) for c in sums))


def ends(prefixes_: DataFrame) -> DataFrame:
    """key, ends_sha256: the SHA-256 of the ids, ascending and joined by commas, of the conversations that end at each node.

    Tasks join ranges of ids into pieces of text; a node's pieces are then hashed in their order, one batch at a time, so
    a node where very many end costs a task bytes to read but no memory.
    """

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = (frame["key"] != frame["key"].shift()).cumsum()
            by = frame.groupby(new, sort=False)
            yield pd.DataFrame({"key": by["key"].first(), "low": by["conv_id"].first(), "ids": by["conv_id"].agg(lambda ids: ",".join(map(str, ids)))})

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hashed = None, None
        for frame in frames:
            done = []
            for k, ids in zip(frame["key"], frame["ids"]):
                if k == key:
                    hashed.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, hashed.hexdigest())], columns=["key", "ends_sha256"])

    rows = prefixes_.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = rows.mapInPandas(solid(pieces), "key binary, low long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "low").mapInPandas(solid(digests), "key binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix of the conversations.

    rebuilt has conv_id, place, turn_sha256 and n_bytes, as shared_openings() gives them. A node's conv_id is the smallest of the n_convs that
    begin with it; n_leaves counts the childless nodes of its subtree, saved_tokens sums (n_convs - 1) x bytes of the last text over it.
    A conversation without turns begins with the root only, and ends there. No rows give no nodes, not even a root.
    """
    rows = written(prefixes(rebuilt))
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    nodes = written(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = subtree_totals(nodes.select("key", "conv_id", "depth", "n_leaves", "saved_tokens"), rows.select("conv_id", "depth", "key"), ["n_leaves", "saved_tokens"], deepest)

    found = nodes.select("key", "conv_id", "depth", "parent", "n_convs", "n_children").join(totals, "key")
    found = found.join(ends(rows), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    found = written(found)
    above = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_children")).where("_children > 0")
    under = meet(found.where("parent is not null"), above, ["parent"], "_children").drop("_children")
    every = under.unionByName(found.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of prefix_trie() for the conversations as shared_openings() rebuilds them.

    Rows without a conv_id are left out; null turns come first, null roles and texts are empty, repeated rows are turns of
    their own, equal turns are ordered by role and text. Texts of any length count by their digest and bytes. Further columns
    change nothing, an empty table gives no rows.
    """
    return prefix_trie(shared_openings(ordered_turns(conversations)))
