"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of them. Edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component): the smallest id reachable, for every id that has an edge.

    Loops and null ends are ignored; no edges gives no rows. Every round is two joins and is written to
    the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = written(edges.where("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        before, edges = edges, written(_small_star(_large_star(edges)))
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components: no fixed point; the graph has a longer path than the rounds allow")
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
