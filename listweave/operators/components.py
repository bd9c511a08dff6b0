"""Connected components of a link table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.session import pinned

MOST_TURNS = 200


def _to_lowest(links: DataFrame) -> DataFrame:
    """Every node's higher neighbours go to its lowest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    higher = both.filter("b > a").join(lowest, "a")
    return higher.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _to_own_lowest(links: DataFrame) -> DataFrame:
    """Every node and its other lower neighbours go to its lowest one."""
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    others = links.join(lowest, "a").filter("b > low").select(F.col("b").alias("a"), "low")
    return others.unionByName(lowest).select("a", F.col("low").alias("b")).distinct()


def component_of(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the links ``(a, b)``, two bigints without nulls; the root is
    the smallest node of the component. Links of a node with itself are left out.

    Links turn into stars by two steps in turns: neighbours above a node go to its lowest neighbour,
    then a node with its neighbours below goes to the lowest of them. Both keep components as they
    are and shorten paths, so the number of turns grows with the logarithm of the nodes. The minima
    are aggregates with a map-side part; a hub's links are split by adaptive skew joins.
    """
    now = pinned(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(MOST_TURNS):
        # All stars: each outer node has one link, and no centre is an outer node.
        several = now.groupBy("a").count().filter("count > 1")
        chained = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi")
        if several.isEmpty() and chained.isEmpty():
            centres = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(centres)
        now = pinned(_to_own_lowest(_to_lowest(now)))
    raise RuntimeError(f"no stars after {MOST_TURNS} turns")
