"""Connected components of a stored list of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored


def _stored(least: DataFrame) -> DataFrame:
    """Written, so that the join below deals both sides out itself and Spark may split a hub's links there."""
    return stored(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = _stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them; links point from larger to smaller."""
    least = _stored(edges.groupBy("a").agg(F.min("b").alias("m")))
    joined = edges.join(least, "a")
    handed = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links(a, b)``; a component is named by its least node.

    Both steps are joins on a node with the minimum over its neighbours, which is folded in each task before the
    shuffle; a hub's links are never gathered. Each round is stored, and only a checksum reaches the driver. Links
    from a node to itself count for nothing.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    checksum = F.expr("count(*)"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")
    before = tuple(edges.agg(*checksum).first())
    while True:
        edges = stored(_small_star(stored(_large_star(edges), "edges")), "edges")
        after = tuple(edges.agg(*checksum).first())
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct().toDF("node", "component")
    )
