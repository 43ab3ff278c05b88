"""Connected components by alternating star contractions; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest id it knows."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low"))
    low = low.select("src", F.least("src", "low").alias("low"))
    larger = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return larger.filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, the smallest of them."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(low, "src")
    return (
        moved.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .filter("src <> dst")
        .unionByName(low.select("src", F.col("low").alias("dst")))
        .distinct()
    )


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge list; the component is its smallest node.

    Edges with a null end and loops count for nothing; repeated edges count
    once.  No edges: no rows.  Each round joins the edges with one row per node
    and writes them, so a lost executor costs one round; the number of rounds
    grows with the logarithm of the graph.
    """
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    edges = (
        edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"), a.alias("a"), b.alias("b"))
        .filter("a <> b")
        .select("src", "dst")
        .distinct()
    )
    edges = scratch.saved(edges, "edges")
    while not _is_forest_of_stars(edges):
        smaller = scratch.saved(_small_star(_large_star(edges)), "edges")
        scratch.drop(edges)
        edges = smaller
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each node has one edge, and what it points to has none."""
    degrees = (
        edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        .unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        .groupBy("node")
        .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    )
    return degrees.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
