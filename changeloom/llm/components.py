"""Connected components of a graph given as edges, by alternating stars.

Each round links the larger neighbours of a node to the smallest of its
neighbourhood, then the smaller ones.  Minima are aggregated map-side, so a hub
never gathers its neighbours in one task; the joins that follow shuffle both
sides for themselves, and adaptive execution splits the hubs in them.  Each round
is written, and the rounds, about the logarithm of the longest path, end when the
edges are stars around the roots.

Defined results: repeated edges, edges in both directions and loops change
nothing; a node without an edge to another node is not in the result; edges with
a null end are ignored; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame, *at_most: str) -> DataFrame:
    """(u, m): the smallest neighbour of each node, or what is smaller in the columns ``at_most``.

    ``u`` is an expression here, so that a join on it has a shuffle of its own on
    both sides: only such joins are split where a key is hot.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.bitwise_not(F.bitwise_not("u")).alias("u"), F.least(*at_most, "m").alias("m") if at_most else "m")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: a node is the larger end of one edge, or the smaller end of any, not both."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("large"), F.lit(0).alias("small"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("large"), F.lit(1).alias("small")))
    return ends.groupBy("node").agg(F.sum("large").alias("large"), F.max("small").alias("small")).where("large + small > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node it reaches."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, turn = scratch.keep(pairs, f"{label}-0"), 0
    while not _settled(now):
        turn += 1
        both = now.union(now.select("v", "u"))
        large = both.join(_least(both, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.union(least.select("u", "m")).distinct(), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
