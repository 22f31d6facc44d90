"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every step is a grouped minimum and a join, so a hub with any number of edges is never gathered.  A round's edges are
a written table; the rounds grow with the logarithm of the longest chain and end when nothing changes.

Defined cases: self edges and repeated edges change nothing, edges with a null end are left out, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b).  Large star: every larger neighbour of a node goes to the node's minimum; small star: every
    smaller one does, and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, left: str = "a", right: str = "b", folder: str | None = None) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of a proper edge.  The rounds are written to
    `folder` where it is given."""
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges", folder), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        edges = written(_star(_star(edges, True), False), "edges", folder)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
