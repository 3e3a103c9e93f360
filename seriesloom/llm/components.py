"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_003))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b): component is the smallest node reachable.

    Each round points the larger neighbours of a node at its least neighbour, then the smaller
    ones; the number of rounds grows with the logarithm of the longest chain. Edges of a round are
    cut by a checkpoint. Least neighbours are aggregates, combined before the shuffle, and a hub with
    many neighbours is the wide side of a join, which adaptive execution can split.
    Links of a node to itself and NULL ends are left out.
    """
    edges = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(turned.union(low).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
