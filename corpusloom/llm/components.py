"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (node, root) for each node that is not the least of its component, which is its root.

    The steps only aggregate and join: a node with very many neighbours is summed in part before it is shuffled, and
    the least neighbours are written before they are joined, so that the join can split such a node.
    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges")
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
