"""Closure of a category graph: breadth first, visited nodes left out, one checkpoint a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth of everything reachable over (src, dst) edges from the (node) roots, the roots at depth 0; cycles end.

    It ends when nothing new is found, however deep that is. Each round writes its frontier only; what was seen is the
    union of the frontiers, which are merged into one table now and then so that the plan stays short.
    """
    edges = checkpointed(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    frontier = checkpointed(roots.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    parts, depth = [frontier], 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        for seen in parts:
            step = step.join(seen.select("node"), "node", "left_anti")
        frontier = checkpointed(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
        if len(parts) > 8:
            parts = [checkpointed(reduce(DataFrame.unionByName, parts))]


def members(edges: DataFrame, roots: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """Pages (title, category) of all categories under the roots, valid titles only, at most ``most`` by title (a
    limit of the feature)."""
    under = closure(edges, roots)
    found = pages.join(under, pages["category"] == under["node"]).select("title").where(F.col("title").rlike(r"^\p{Lu}")).distinct()
    return found if most is None else found.orderBy("title").limit(most)
