"""Connected components of an edge table, by large and small stars.

Each round points every vertex's larger neighbours, then its smaller ones, at
its smallest neighbour, until the edges are stars around the smallest vertex
of their component. A round is a partial aggregate (the smallest neighbour)
and a join on the vertex, so a vertex with very many edges moves one partial row
per task and its join partition can be split. Rounds are written to the
shared folder; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return edges.join(least, "u")


def _pairs(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, component``: the smallest vertex that each vertex of an edge reaches. Ends must not be null."""
    edges = materialize(_pairs(a, b, edges))  # u > v
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours v of u go to m
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, go to m; here each u > v already
        small = _stars(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct())
        # done when no child is a parent and each child has one parent
        state = after.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
                                               F.struct(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("s"))
        bad = state.groupBy("s.x").agg(F.sum("s.child").alias("c"), F.max("s.parent").alias("p")).where("c > 1 OR (c = 1 AND p = 1)")
        if bad.isEmpty():
            break
        edges = after
    roots = after.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
