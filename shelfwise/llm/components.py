"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al. (2014). Each step is one group minimum (map-side combined) and one join on a node, so a node with very
many links is never gathered in one row: its partition of the join is one that adaptive execution splits. Every
step writes its edges to the shared folder and deletes those before it. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, stash


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: link a node's larger neighbours to its least neighbour; small: its smaller ones."""
    if small:
        arcs = edges
    else:
        arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = arcs.join(least, "u")
    if small:
        pairs = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                             F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        out = pairs.select("p.u", "p.v")
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the edges (a, b)."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = stash(pairs, "cc"), None
    while True:
        known, current = current, stash(_star(_star(current, small=False), small=True), "cc")
        discard(known)
        state = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
