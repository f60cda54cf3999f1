"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled_rows


def _with_low(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest neighbour of u, u itself included."""
    low = edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("low"))
    return edges.join(low, "u")


def _are_stars(e: DataFrame) -> bool:
    """Whether each node has one edge downwards, or only edges from above."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("lo")).where("n > 1 or (n = 1 and lo = 0)").isEmpty()


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Map each node of undirected edges (u, v) to the smallest node of its component: (node, root). n: how many edges at most.

    Large and small stars alternate until the edges form stars around the roots, in about the logarithm of the
    longest chain. Only the answer whether they do leaves the executors; each round ends in a reliable checkpoint.
    Neighbours of a hub are reduced before the shuffle, and the joins are left to adaptive skew splitting. No
    edges: no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        large = _with_low(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x"))
        # a round leaves no more than one edge downwards for each end of an edge
        e, n = settled_rows(small.select("x.u", "x.v").where("u <> v").distinct(), most=None if n is None else 2 * n)
        if _are_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
