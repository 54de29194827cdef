"""Connected components of a link table by alternating stars.

Each round points every node's neighbours at the smallest node it knows.  A round is
two aggregates and two joins; a node's smallest neighbour is found by a map-side
combining minimum, so a node with a third of all links is no task of its own, and the
joins are plain shuffles whose skewed parts Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.durable import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours above a node (large) or not above it (small) point at its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.filter("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = seen.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    moved = moved.filter("u <> v")
    return moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label`` of every linked node; the label is the smallest node of its component.

    Links that hold a null or join a node to itself say nothing.  An empty table gives
    an empty table.  Repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = store(edges.filter("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(edges)
    while before[0]:
        edges = store(_star(_star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
