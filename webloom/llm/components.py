"""Connected components of a distributed edge list, in DataFrame operations.

Alternating star contraction: every node points its larger neighbours to its
least neighbour, then its smaller ones, until each component is a star around
its least node. Lineage is cut by a written table in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import stored


def star_step(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b), a < b, after one step."""
    if larger:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        kept = around.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = kept.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; longs, a < b): the least node that can be reached."""
    edges = stored(edges.distinct(), "edges")
    before = None
    while (now := mark(edges)) != before:
        before = now
        edges = stored(star_step(star_step(edges, True), False), "edges")
    # All edges are stars by now: (component, node).
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
