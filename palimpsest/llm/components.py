"""Connected components by alternating large and small stars.

Every step keeps components and shrinks distances, so the number of rounds grows with the logarithm
of the longest chain. A hub's edges are never gathered: minima are combined before their shuffle and
joined back from a written table, by broadcast if Spark finds it small, else by a join that adaptive
execution can split. Edges are written after each step, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the smallest node of its component.

    Loops, repeated edges and either direction are fine; edges with a null end are left out.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = pairs.where("u = v").select("u").distinct()
    now = written(pairs.where("u <> v").distinct(), "edges")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        now = written(_small_star(written(_large_star(now), "large")), "small")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).union(loops.join(now, "u", "left_anti").selectExpr("u as node", "u as root"))
    return linked.unionByName(roots.distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour (or itself, if that is smaller)."""
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).where("u <> v").distinct()
