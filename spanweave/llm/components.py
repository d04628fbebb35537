"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import keep


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it reaches.

    Alternating large-star and small-star steps: each links the neighbours of a node to the
    smallest one, so the number of edges does not grow and the number of rounds is
    logarithmic. A hub's neighbours are only aggregated (a minimum, combined before the
    shuffle) and joined, never collected; AQE splits the join of a hub's rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    while True:
        # Large star: link every larger neighbour to the smallest node around.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: link a node and its smaller neighbours to the smallest of them.
        large = keep(large.where("a <> b"), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first())
        if state == before:
            break
        before = state
    # At rest every node has one edge, to the smallest node of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
