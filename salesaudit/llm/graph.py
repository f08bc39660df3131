"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.shared import saved


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) with the lowest of u and all its v beside each pair."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(lowest, "u").select("u", "v", F.least("u", "low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, lowest node of its component) of the nodes in ``edges`` (u, v).

    Large-star and small-star steps take turns until no edge changes: each node
    is tied to ever lower ones. A node with very many edges is never gathered:
    minima combine before the shuffle, and the join back can be split.
    """
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before is not None and tuple(mark) == before:
            break
        before = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").distinct()
        small = _lowest(large)
        tied = small.select(F.col("v").alias("u"), F.col("low").alias("v"))
        tied = tied.unionByName(small.select("u", F.col("low").alias("v"))).filter("u > v").distinct()
        edges = saved(tied, "edges")
    lowest = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(lowest, "u", "left_anti")
    return lowest.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
