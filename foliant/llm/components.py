"""Connected components by alternating stars (Kiveris et al., 2014), all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch


def _least(edges: DataFrame, of: str) -> DataFrame:
    """The least neighbour of each node, or the node itself if that is smaller; sums partially before the shuffle."""
    return edges.groupBy(F.col(of).alias("_n")).agg(F.least(F.min("u"), F.min("v")).alias("_m"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``component`` (its least member) of each node of the links *a*, *b*; nodes without links have no row.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least of them. A hub's rows meet
    its least neighbour in a sort-merge join that adaptive execution splits.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u")
        large = both.filter("v > u").join(least, F.col("u") == F.col("_n")).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large)
        least = _least(large, "u")
        joined = large.join(least, F.col("u") == F.col("_n"))
        small = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select(F.col("_n").alias("u"), F.col("_m").alias("v"))).filter("u <> v").distinct()
        new = scratch.save(small)
        scratch.drop(edges, large)
        edges = new
        roots = edges.select(F.col("v").alias("r")).distinct()
        if edges.join(roots, F.col("u") == F.col("r"), "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
