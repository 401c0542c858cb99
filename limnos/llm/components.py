"""Connected components by alternating large-star and small-star steps, in DataFrame functions.

Each step joins edges with one row a node (its least neighbour), so no node's neighbours meet in one task's memory,
and a hub's edges can be split by the engine. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: every node of an edge with the least node of its component. Loops, repeated edges and null ends are ignored."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = materialize(e.distinct(), "edges")
    seen = _mark(e)
    while seen[0]:
        # Large star: a node's larger neighbours are tied to the least of its neighbours and itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = _mark(after)
        discard(e)
        e = after
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
