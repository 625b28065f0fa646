"""Connected components of an edge table, by joins that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed


def _with_lowest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``low``, the lowest of u and all its v.

    The lowest is an aggregate joined back, so that a node of very many edges is split like any
    skewed join.
    """
    lowest = edges.groupBy("u").agg(F.min("v").alias("of_v"))
    return edges.join(lowest.select("u", F.least("u", "of_v").alias("low")), "u")


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); the component is its lowest node.

    Large-star and small-star steps take turns: every edge is redrawn to the lowest neighbour of
    its node, first for the neighbours above, then for those below it, until nothing changes.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = checkpointed(edges.distinct(), "components")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        ranked = _with_lowest(large)
        small = (
            ranked.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(ranked.select("u", F.col("low").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = checkpointed(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.unionByName(roots)
