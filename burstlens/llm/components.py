"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over the edge list, staged in
the shared folder.  The minima are staged as well, so both sides of each join
are plain shuffles that adaptive execution can split when one node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _print(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stage(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the smallest
    node of the component.  Nodes without an edge do not appear; loops, null
    ends and repeated edges are ignored.  An empty list gives an empty result."""
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (seen := _print(now)) != before and seen["n"]:
        before = seen
        now = stage(_small_star(stage(_large_star(now), "large")), "small")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
