"""Connected components of a link table by alternating large-star and small-star steps, each a few shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _rewire(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (large step) or smaller (small step) neighbours of every node at its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    out = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, either way round -> (node, root), root being the smallest node of the component; lone nodes are left out.

    Sums of minima combine before each shuffle; joins on hot nodes are split by adaptive execution. Every round is
    checkpointed in the shared folder, so a lost executor costs one round at most.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        after = materialise(_rewire(_rewire(edges, True), False))
        # Stars only, nothing moved: each node has one parent and no parent has a parent.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
