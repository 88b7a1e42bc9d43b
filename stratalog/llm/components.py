"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u long, v long); root is the smallest node of its component.

    Each round every node hooks to the smallest node next to it, the chains of hooks
    are shortened by two jumps, and the graph is contracted to the roots so far.
    No round holds more than one row for each link, and the hot keys (nodes that
    many others point to) are met only in joins of two plain tables, which AQE splits.
    """
    at = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    edges = written(links.where("u <> v").select(*at).distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("to")), "hooks")
        for _ in range(2):
            far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            hook = written(hook.join(far, "to").select("node", F.least("to", "far").alias("to")), "hooks")
        steps.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = hook.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = written(edges.join(left, "u").select("a", "v"), "moved").join(right, "v").where("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    roots = steps[0]
    for later in steps[1:]:
        roots = written(roots.join(later.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left").select("node", F.coalesce("far", "to").alias("to")), "roots")
    return roots.select("node", F.col("to").alias("root"))
